import os
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import filters
from pathloom.operators.joins import fits_broadcast, lookup_join
from pathloom.plans.build import crawl_entries, plan_roots
from pathloom.sources.catalog import crawl, list_roots, split_errors


def frame(spark, paths, name="path"):
    return spark.createDataFrame([(p,) for p in paths], f"{name} string")


def values(df, name="path"):
    return sorted(r[name] for r in df.select(name).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    # One key holds most rows, some keys are missing, some rows are exact copies.
    big = spark.createDataFrame([("hot", i % 50) for i in range(500)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("c", 3)], "k string, w int")
    small = lookup_join(big, lookup, "k", how, small=True)
    salted = lookup_join(big, lookup, "k", how, small=False)
    key = lambda r: tuple(str(x) for x in r)
    columns = small.columns
    assert sorted(map(key, small.collect())) == sorted(map(key, salted.select(*columns).collect()))


def test_size_check(spark):
    assert fits_broadcast(spark.range(10), 10)
    assert not fits_broadcast(spark.range(11), 10)
    wide = spark.range(40).select(F.repeat(F.lit("x"), 2 << 20).alias("s"))
    assert not fits_broadcast(wide, 100)


@pytest.mark.parametrize("lengths", [32, 0])
def test_exclude_prefix_forms_agree(spark, monkeypatch, lengths):
    monkeypatch.setattr(filters, "INLINE_LENGTHS", lengths)
    rng = random.Random(7)
    part = lambda: rng.choice(["lib", "libx", "usr", "u", "data"])
    paths = ["/" + "/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["/hot/x"] * 200 + [None]
    prefixes = ["/lib", "/u", "/data/usr", "/hot", "/usr/libx/", "/nowhere/at/all/deep"]
    want = sorted(p for p in paths if p is not None and not any(p.startswith(x) for x in prefixes))
    by_list = filters.exclude_prefix(frame(spark, paths), prefixes)
    by_frame = filters.exclude_prefix(frame(spark, paths), frame(spark, prefixes + prefixes[:2], "prefix"))
    assert values(by_list.where("path IS NOT NULL")) == want
    assert values(by_frame.where("path IS NOT NULL")) == want


def test_component_match(spark):
    paths = frame(spark, ["/lib", "/lib/a", "/library", "/libx/b"])
    raw = paths.where(filters.starts_with_any("path", ["/lib"]))
    component = paths.where(filters.starts_with_any("path", ["/lib"], component=True))
    assert values(raw) == ["/lib", "/lib/a", "/library", "/libx/b"]
    assert values(component) == ["/lib", "/lib/a"]


@pytest.mark.parametrize("component", [False, True])
@pytest.mark.parametrize("lengths", [32, 0])
def test_component_forms_agree(spark, monkeypatch, lengths, component):
    monkeypatch.setattr(filters, "INLINE_LENGTHS", lengths)
    rng = random.Random(11)
    part = lambda: rng.choice(["a", "ab", "a b", "天", "天地", "\U0001f600", ""])
    paths = ["/" + "/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["", "/", None, "/a"]
    prefixes = ["/a", "/ab/", "/天", "/a b/a", "/a b//", "/a/a/a/a", "/\U0001f600/天", "/a"]

    def hit(path, prefix):
        return path == prefix or path.startswith(prefix.rstrip("/") + "/") if component else path.startswith(prefix)

    want = sorted(p for p in paths if p is not None and not any(hit(p, x) for x in prefixes))
    rows = frame(spark, paths).selectExpr("path", "'n' AS n", "1 AS `a.b`")
    for given in (prefixes, frame(spark, prefixes + [None], "prefix")):
        got = filters.exclude_prefix(rows, given, component=component)
        assert got.columns == rows.columns
        assert got.where("path IS NULL").count() == 1
        assert values(got.where("path IS NOT NULL")) == want


@pytest.mark.parametrize("lengths", [32, 0])
def test_empty_tables_and_the_empty_prefix(spark, monkeypatch, lengths):
    monkeypatch.setattr(filters, "INLINE_LENGTHS", lengths)
    paths, none = frame(spark, ["/a", "", None]), frame(spark, [], "prefix")
    assert paths.count() == filters.exclude_prefix(paths, none).count()
    assert filters.exclude_prefix(frame(spark, []), frame(spark, ["/a"], "prefix")).count() == 0
    left = filters.exclude_prefix(paths, frame(spark, ["", "/a"], "prefix"))
    assert [r["path"] for r in left.collect()] == [None]


def test_intervals_move_the_rows_and_not_their_prefixes(spark):
    """A hundred thousand nested prefixes of 200 lengths: no row is multiplied by lengths."""
    prefixes = spark.range(100_000).selectExpr("concat('/p', id % 500, repeat('/x', CAST(id % 200 AS INT)), '/', id) AS prefix")
    rows = spark.range(3_000).selectExpr("concat('/p', id % 500, repeat('/x', CAST(id % 200 AS INT)), '/', id, '/f') AS path")
    rows = rows.unionByName(spark.range(2_000).selectExpr("'/p1/hot/one' AS path"))
    left = filters.exclude_prefix(rows, prefixes)
    assert "Generate" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert left.count() == 2_000


@pytest.mark.parametrize("as_frame", [False, True])
def test_prune_equals_walk(spark, as_frame):
    rng = random.Random(3)
    tree = {"/r": True}
    folders = ["/r"]
    for i in range(200):
        up = rng.choice(folders)
        path = f"{up}/{rng.choice('abc')}{i % 23}"
        if path not in tree:
            tree[path] = rng.random() < 0.5
            if tree[path]:
                folders.append(path)
    excludes = ["/r/a1", "/r/b2", "/r/c", "/r/a5/b"]

    def walk(path):
        yield path
        if tree[path] and (path == "/r" or not any(path.startswith(x) for x in excludes)):
            for child in tree:
                if child.rsplit("/", 1)[0] == path:
                    yield from walk(child)

    rows = frame(spark, list(tree))
    got = filters.prune_subtrees(rows, "/r", frame(spark, excludes, "prefix") if as_frame else excludes)
    assert values(got) == sorted(walk("/r"))


def test_root_planning(spark):
    """A root that is excluded exactly goes away with its exclude; /libx stays and is crawled."""
    paths = ["/lib", "/lib/x", "/libx", "/libx/f", "/home", "/home/lib", "/home/.cache", "/home/.cache/z"]
    files = frame(spark, paths).selectExpr("path", "true AS is_dir", "1L AS size", "current_timestamp() AS mtime", "CAST(NULL AS string) AS error")
    roots, rest = plan_roots(files, frame(spark, ["/lib", "/home/.cache"], "prefix"))
    assert values(roots) == ["/home", "/libx"]
    assert values(rest, "prefix") == ["/home/.cache"]
    got = values(crawl_entries(files, roots, rest))
    assert got == ["/home", "/home/.cache", "/home/lib", "/libx", "/libx/f"]
    assert values(list_roots(files, "/home")) == ["/home/.cache", "/home/lib"]
    assert values(list_roots(files, "/absent")) == []


def test_live_crawl(spark, tmp_path):
    for name in ("a/b", "a/.hidden", "skip/deep/er", "empty"):
        os.makedirs(tmp_path / name)
    for name in ("a/one.txt", "a/.hidden/_two", "skip/three", "skip/deep/four", ".dot"):
        (tmp_path / name).write_text(name)
    root = str(tmp_path)
    want = sorted([root] + [os.path.join(d, n) for d, ds, fs in os.walk(root) for n in ds + fs])
    found = crawl(spark, root)
    assert values(found) == want
    sizes = {r.path: r["size"] for r in found.where("not is_dir").collect()}
    assert sizes[f"{root}/a/one.txt"] == len("a/one.txt")
    pruned = values(crawl(spark, root, [f"{root}/skip"]))
    assert pruned == sorted(p for p in want if not p.startswith(f"{root}/skip/"))
    usable, errors = split_errors(crawl(spark, f"{root}/absent"))
    assert usable.count() == 0 and errors.count() == 1


def test_root_goes_to_errors(spark):
    files = spark.createDataFrame([("/", None), ("/a", None), ("/b", "denied")], "path string, error string")
    usable, errors = split_errors(files)
    assert values(usable) == ["/a"] and values(errors) == ["/", "/b"]

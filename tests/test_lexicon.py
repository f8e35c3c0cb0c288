import itertools
import math
import random
import re
from collections import Counter

from pathloom.operators import lexicon as L

WORDS = ["天地", "玄黄", "宇宙洪", "日", "月盈昃", "辰宿"]


def names(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, name string")


def sample(seed, count=120):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) + rng.choice(["", "-x", "1天"]) for _ in range(count)]
    return texts + [None, "", "plain", texts[0], texts[0]]


def learned(texts, longest, least, cohesion, freedom):
    grams, before, after = Counter(), {}, {}
    for run in (r for t in texts if t for r in re.findall("[\u4e00-\u9fff]+", t)):
        for i, j in itertools.combinations(range(len(run) + 1), 2):
            if j - i <= longest:
                word = run[i:j]
                grams[word] += 1
                before.setdefault(word, Counter())[run[i - 1 : i] if i else ""] += 1
                after.setdefault(word, Counter())[run[j : j + 1]] += 1
    total = sum(n for w, n in grams.items() if len(w) == 1)
    entropy = lambda c: math.log(sum(c.values())) - sum(n * math.log(n) for n in c.values()) / sum(c.values())
    rows = {}
    for word, n in grams.items():
        free = min(entropy(before[word]), entropy(after[word])) * 1000
        held = None
        if len(word) > 1:
            held = 1000 * min(math.log(n * total / (grams[word[:k]] * grams[word[k:]])) for k in range(1, len(word)))
            if n < least or round(held) < cohesion or round(free) < freedom:
                continue
        rows[word] = (n, held, free, -1000 * math.log(n / total))
    return rows


def test_lexicon_equals_brute_force(spark):
    texts = sample(5)
    want = learned(texts, 4, 5, 200, 300)
    got = {r["word"]: r for r in L.learn_lexicon(names(spark, texts), "name", least=5, cohesion=200, freedom=300).collect()}
    assert set(got) == set(want) and any(len(w) > 1 for w in got)
    for word, (n, held, free, cost) in want.items():
        row = got[word]
        assert row["n"] == n and abs(row["freedom"] - free) <= 0.51 and abs(row["cost"] - cost) <= 0.51
        assert (row["cohesion"] is None) == (held is None) and (held is None or abs(row["cohesion"] - held) <= 0.51)


def ways(run, longest):
    if not run:
        yield ()
    for k in range(1, min(longest, len(run)) + 1):
        for rest in ways(run[k:], longest):
            yield (run[:k], *rest)


def test_path_is_the_cheapest_of_all(spark):
    texts = sample(9, 40)
    rows = L.learn_lexicon(names(spark, texts), "name", cohesion=200, freedom=300)
    costs = {r["word"]: r["cost"] for r in rows.collect()}
    total = sum(r["n"] for r in rows.collect() if len(r["word"]) == 1)
    unseen = round(-1000 * math.log(0.5 / total))
    held_out = texts + ["天龙地", "龙"]
    got = {(r["doc_id"], r["run_no"]): r["words"] for r in L.segment(names(spark, held_out), "name", rows).collect()}
    price = lambda w: costs.get(w, unseen if len(w) == 1 else math.inf)
    seen = 0
    for doc, text in enumerate(held_out):
        for no, run in enumerate(re.findall("[\u4e00-\u9fff]+", text or "")):
            words = got.pop((doc, no))
            assert "".join(words) == run
            assert sum(map(price, words)) == min(sum(map(price, way)) for way in ways(run, 4))
            seen += any(len(w) > 1 for w in words)
    assert not got and seen


def test_long_runs_empty_tables_and_an_empty_lexicon(spark):
    none = names(spark, [])
    empty = L.learn_lexicon(none, "name")
    assert empty.count() == 0 and L.segment(none, "name", empty).count() == 0
    assert [r["words"] for r in L.segment(names(spark, ["天地"]), "name", empty).collect()] == [["天", "地"]]
    long = "天地玄" * 200
    rows = L.segment(names(spark, [long, long]), "name", L.learn_lexicon(names(spark, [long]), "name")).collect()
    for doc in (0, 1):
        runs = [r for r in sorted(rows, key=lambda r: r["run_no"]) if r["doc_id"] == doc]
        assert [len("".join(r["words"])) for r in runs] == [256, 256, 88]
        assert "".join(w for r in runs for w in r["words"]) == long

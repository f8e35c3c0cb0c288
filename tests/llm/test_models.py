"""Classifier, language model and chat repair: held-out accuracy, gradients, brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat_repair, quality, recurrent_lm

# ------------------------------------------------------------------ quality


def labelled(rng, n):
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = rng.choices(plain, k=rng.randint(20, 80))
        if grade == 0:
            words[::9] = ["Awful"] * len(words[::9])
        if grade == 1:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades_are_found(frame):
    rng = random.Random(1)
    rows = labelled(rng, 900)
    docs = frame([(*r, "x") for r in rows] + [(None, "no id", 0, "x"), (2000, None, 0, "x"), (2001, "", 0, "x"), (2002, "word1 " * 20_000, 2, "x")], "doc_id long, text string, truth int, rating string")
    ratings = frame([(r[0], r[2]) for r in rows[:600]] + [(5, None), (None, 0), (10**9, 1)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    scored = {r.doc_id: (r.truth, r.rating) for r in quality.score(docs, model).collect()}
    assert len(scored) == 904
    held = [scored[i] for i in range(600, 900)]
    assert np.mean([t == r.grade for t, r in held]) > 0.95
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for _, r in scored.values())
    assert scored[2000][1] == scored[2001][1]
    kept = {r.doc_id for r in quality.select_good(docs, ratings).select("doc_id").collect()}
    assert np.mean([(i in kept) == (scored[i][0] == 2) for i in range(600, 900)]) > 0.95
    assert quality.fit(docs, ratings, sample=50).weights.shape == model.weights.shape


def test_nothing_rated_rejects_nothing(frame):
    docs = frame([(1, "a"), (2, None)], "doc_id long, text string")
    none = frame([], "doc_id long, grade int")
    assert quality.fit(docs, none) is None and quality.select_good(docs, none).count() == 2
    one = quality.fit(docs, frame([(1, 2)], "doc_id long, grade int"))
    assert quality.score(docs, one).count() == 2 and quality.score(docs.limit(0), one).count() == 0


# ------------------------------------------------------------------ language model


def test_gradients_are_differences_of_the_loss():
    rng = np.random.default_rng(0)
    net = recurrent_lm.Network.fresh(np.full(recurrent_lm.CLASSES, 1 / recurrent_lm.CLASSES))
    x, y = rng.integers(0, 40, (2, 5, 7)).astype(np.int16)
    start, live = np.zeros((5, 7), bool), np.ones((5, 7), bool)
    start[0, :3] = start[2, 1] = True
    live[4, 5:] = False
    h = rng.normal(0, 0.5, (recurrent_lm.HIDDEN, 7)).astype(np.float32)
    flat = net.flat().astype(np.float64)
    gradient = np.concatenate([g.ravel() for g in net.gradient(x, y, start, live, h)[1]])
    for i in rng.integers(0, len(flat), 80):
        step = np.zeros(len(flat))
        step[i] = 1e-2
        up, down = (recurrent_lm.Network.of(flat + s).gradient(x, y, start, live, h)[0] for s in (step, -step))
        assert (up - down) / 2e-2 / live.sum() == pytest.approx(gradient[i], abs=2e-4)


def test_the_network_has_its_whole_size():
    """64 classes, of which 24 of one word, and 16 hidden units: not cut for time."""
    net = recurrent_lm.Network.fresh(np.full(recurrent_lm.CLASSES, 1 / recurrent_lm.CLASSES))
    assert recurrent_lm.OWN >= 24 and net.output.shape[1] >= 64 and net.state.shape[0] >= 16
    assert len({recurrent_lm.shared_class(b"%03d" % i) for i in range(1000)}) == net.output.shape[1] - recurrent_lm.OWN


def test_windows_carry_the_state_through_whole_documents():
    rng = np.random.default_rng(1)
    net = recurrent_lm.Network.fresh(np.full(recurrent_lm.CLASSES, 1 / recurrent_lm.CLASSES))
    docs = [rng.integers(0, 40, int(n)).astype(np.int16) for n in [*rng.integers(1, 90, 400), 700]]
    got = recurrent_lm.log10_chances(net, docs)
    for i in (0, 5, 117, 399, 400):
        h, before, total = np.zeros((recurrent_lm.HIDDEN, 1), np.float32), 0, 0.0
        for place, c in enumerate(docs[i]):
            after = net.forward(np.array([[before]]), np.array([[place == 0]]), h)[-1]
            total += net.log_chances(after, np.array([[c]]))[0, 0] / math.log(10)
            h, before = after[-1], c
        assert got[i] == pytest.approx(total, rel=1e-5)


@pytest.mark.parametrize("frequent", [1 << 17, 5])
def test_scores_of_small_tables(frame, monkeypatch, frequent):
    monkeypatch.setattr(recurrent_lm, "FREQUENT", frequent)
    rng = random.Random(2)
    tongues = [[f"{c}{i}" for i in range(30)] for c in "xyz"]
    rows = [(i, " ".join(rng.choices(rng.choice(tongues), k=rng.randint(1, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "Unseen Words only"), (3, rows[3][1]), (None, "x1 X2"), (503, "x1 " * 3000)]
    got = recurrent_lm.score(frame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows)

    def tokens(text):
        return [*(text or "").lower().split(), ""]

    train = Counter()
    for doc, text in rows:
        if zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 != 1:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    want = []
    for doc, text in rows:
        own = tokens(text)
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        held = zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1
        want.append((str(doc), held, len(own), sum(train[w] > 0 for w in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert recurrent_lm.score(frame([], "doc_id long, text string")).count() == 0


def test_chances_add_up_to_one(frame):
    """The classes' chances add up, and within a class the words' shares and that of unseen words."""
    net = recurrent_lm.Network.fresh(np.full(recurrent_lm.CLASSES, 1 / recurrent_lm.CLASSES))
    after = net.forward(np.zeros((1, 1), int), np.ones((1, 1), bool), np.zeros((recurrent_lm.HIDDEN, 1), np.float32))[-1]
    logs = [net.log_chances(after, np.array([[c]]))[0, 0] for c in range(recurrent_lm.CLASSES)]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
    counts = recurrent_lm.count_words(frame([(1, "a b b c cc ccc dd " * 9)], "key long, text string"))
    words = recurrent_lm.vocabulary(counts)
    codes = recurrent_lm.Codes(words)
    by_class = Counter()
    for r in counts.collect():
        by_class[codes.kinds[codes[bytes(r.word)]]] += r.n + 0.5
    for c, total in by_class.items():
        assert total + 0.5 == pytest.approx(words.class_total[c])
    assert codes.kinds[codes[b"unseen"]] >= recurrent_lm.OWN
    codes.forget()
    assert b"unseen" not in codes and len(codes.words) == codes.known


def test_held_out_likelihood_beats_the_unigram(frame):
    rng = random.Random(3)
    tongues = [[f"{c}{i}{e}" for i in range(60)] for c, e in (("x", "ung"), ("y", "tion"), ("z", "ado"))]
    rows = [(i, " ".join(rng.choices(rng.choice(tongues), k=120))) for i in range(700)]
    got = recurrent_lm.score(frame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ------------------------------------------------------------------ chat


def brute_cost(roles, costs):
    """Least cost over all labels, merges and insertions, by trying all of them."""
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
    names = [chat_repair.number_of(r) for r in roles]
    best = math.inf
    for labels in itertools.product((1, 2, 3), repeat=len(names)):
        cost = sum(0 if a == b else costs.unknown if b == 0 else costs.relabel for a, b in zip(labels, names))
        state = {0: cost}
        for role in labels:
            after = {}
            for at, c in state.items():
                if at == role:
                    after[role] = min(after.get(role, math.inf), c + costs.merge)
                reach, steps = {at: 0}, [at]
                while steps:
                    s = steps.pop(0)
                    if role in legal[s]:
                        after[role] = min(after.get(role, math.inf), c + costs.insert * reach[s])
                    for t in legal[s]:
                        if t not in reach:
                            reach[t] = reach[s] + 1
                            steps.append(t)
            state = after
        for at, c in state.items():
            best = min(best, c + costs.insert * {0: 0, 1: 2, 2: 1, 3: 0}[at])
    return best


@pytest.mark.parametrize("block", [512, 2])
def test_repairs_are_legal_and_cheapest(frame, monkeypatch, block):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    rng = random.Random(4)
    costs = chat_repair.Costs()
    convs = {i: [rng.choice(["system", "User ", "assistant", "GPT", None, "tool"]) for _ in range(rng.randint(1, 6))] for i in range(60)}
    rows = [(i, k, r, f"t{k}" if rng.random() < 0.9 else None, 0) for i, roles in convs.items() for k, r in enumerate(roles)]
    out = chat_repair.repair(frame(rows, "conv_id long, turn long, role string, text string, sub int")).collect()
    for i, roles in convs.items():
        own = sorted((r for r in out if r.conv_id == i), key=lambda r: (r.turn, r.sub))
        cost = 0
        turns = []
        for r in own:
            before = chat_repair.number_of(r.was)
            if r.action == "insert":
                cost += costs.insert
            elif "relabel" in r.action:
                cost += costs.unknown if before == 0 else costs.relabel
            if "merge" in r.action:
                cost += costs.merge
                assert turns[-1] == r.role
            else:
                turns.append(r.role)
        body = turns[1:] if turns[0] == "system" else turns
        assert body == [["user", "assistant"][k % 2] for k in range(len(body))] and body and body[-1] == "assistant"
        assert cost == brute_cost(roles, costs)
        assert [r.was for r in own if r.action != "insert"] == roles
        text = "".join(r.rendered for r in own)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") == len(turns)
        assert [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]] == turns and text.endswith("<|im_end|>\n")


def test_odd_conversations(frame):
    rows = [(1, None, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 3, "user", None), (None, 4, "assistant", "x" * 100_000), (2, -5, None, "c"), (2, 2**40, "system", "d")]
    out = chat_repair.repair(frame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.action != "insert" for r in out) == len(rows)
    assert [r.action for r in sorted((r for r in out if r.conv_id is None), key=lambda r: r.turn)] == ["keep", "keep"]
    assert chat_repair.repair(frame([], "conv_id long, turn long, role string, text string")).count() == 0

"""Hard negatives, Merkle manifest and chat windows against brute force, with their odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, frames, merkle, negatives
from tidepanel.llm.queries import QUERIES, RANKS

DATA = "/root/testdata/sf0.001"
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


# ---------------------------------------------------------------- hard negatives

def brute_mine(rows, every, rules=negatives.Rules()):
    ready = set()
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or sum(256 * x * 256 * x for x in v) >= 2 ** 62:
            continue
        ready.add((i, label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for i, label, v in ready:
        if i % every:
            continue
        score = lambda r: sum(a * b for a, b in zip(v, r[2]))
        others = sorted(((score(r), r[0], r[1]) for r in ready if r[0] != i), key=lambda x: (-x[0], x[1]))
        for s, p, _ in [x for x in others if x[2] == label][:rules.positives]:
            fits = [x for x in others if x[2] != label and rules.least * s <= 100 * x[0] <= rules.most * s]
            out += [(i, p, k + 1, x[1], s, x[0]) for k, x in enumerate(fits[:rules.negatives])]
    return sorted(out)


def mined(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<double>").withColumn("slab", F.lit("x")).withColumn("score", F.lit(None))
    return sorted(tuple(r) for r in negatives.mine(df, every).collect())


def vectors(n, width=12, seed=5):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, width))
    return [(i, int(g.integers(4)), [float(x) for x in 0.3 * (centres[i % 6] + 0.6 * g.normal(size=width))]) for i in range(n)]


def test_negatives_match_all_pairs_over_many_small_leaves(spark, monkeypatch):
    for name, value in (("LEAF", 8), ("FANOUT", 3), ("SLAB_ROWS", 150), ("SLAB_LEAST", 50)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(700)
    hot = rows[10][2]
    rows += [(1000 + k, k % 2, hot) for k in range(150)]            # one vector with a sixth of the rows: ties by id
    got = mined(spark, rows, 20)
    assert got and got == brute_mine(rows, 20)


def test_negatives_of_odd_rows(spark):
    rows = vectors(60) + [(None, 1, [1.0]), (61, None, [1.0] * 12), (62, 1, None), (63, 1, [None] * 12), (64, 1, [float("nan")] * 12), (65, 1, [float("inf")] * 12),
                          (66, 1, [1e300] * 12), (70, 1, []), (80, 2, [3.0]), (90, 0, [0.5] * 20), (100, 3, [1e6] * 12), (101, 3, [2e6] * 12), (102, 1, [9e5] * 12), (-10, 1, [0.2] * 12),
                          (20, 1, [0.3] * 12)]
    rows += [rows[0]] * 3 + [rows[-1]]
    assert mined(spark, rows, 10) == brute_mine(rows, 10)
    assert mined(spark, [], 10) == []
    assert mined(spark, [(100, 1, [1.0]), (101, 2, [0.5])], 100) == []   # an anchor without a positive


def test_negatives_query_matches_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, DATA).collect()) == brute_mine(rows, 100)


def test_boxes_hold_their_rows_and_prune():
    g = np.random.default_rng(1)
    v = g.integers(-200, 200, (500, 6))
    ids, labels = np.arange(500), g.integers(0, 3, 500)
    packed = negatives.pack(ids, labels, v, 16)
    assert sorted(np.concatenate([p for _, p in packed]).tolist()) == list(range(500)) and max(len(p) for _, p in packed) <= 16
    forest = negatives.Forest([(label, ids[p], v[p]) for label, p in packed])
    q = g.integers(-200, 200, (5, 6))
    least, most = forest.intervals(q, forest.low, forest.high)
    for k, (_, p) in enumerate(packed):
        s = q @ v[p].T
        assert (least[:, k] <= s.min(axis=1)).all() and (s.max(axis=1) <= most[:, k]).all()


# ---------------------------------------------------------------- Merkle manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute_tree(level, fanout):
    """Root, and per leaf its path of (left, right)."""
    paths, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p // fanout * fanout
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + fanout])))
            place[i] = p // fanout
        level = [SHA("".join(level[k:k + fanout])) for k in range(0, len(level), fanout)]
    return level[0], paths


def brute_manifest(rows, fanout):
    leaf = lambda r: SHA("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = brute_tree([d for _, d in groups[g]], fanout)
    root, above = brute_tree([trees[g][0] for g in names], fanout)
    return sorted((str(i), d, trees[g][0], root, tuple(trees[g][1][k] + above[j])) for j, g in enumerate(names) for k, (i, d) in enumerate(groups[g]))


@pytest.mark.parametrize("fanout,levels", [(2, 3), (3, 2), (2, 10)])
def test_manifest_matches_a_plain_tree(spark, fanout, levels):
    r = random.Random(2)
    rows = [(i, r.choice(["a", None]), r.choice(["en", "en", "en", "dé", "", None]), r.choice([5, None]), r.choice(["x" * (i % 50), "", None])) for i in range(150)]
    rows += [(None, None, "en", 1, "no id"), (3, "s", "zz", 9, "alone"), (7, "s", "en", 1, "é" * 40_000)] + [rows[4]] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("grp", "leaf", "path", "bucket")})
    made = merkle.manifest(df, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "path": F.col("path")}, fanout, levels)
    made = made.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(x.again == x.root for x in made)
    got = sorted((str(x.row.doc_id), x.leaf, x.subroot, x.root, tuple((p.left, p.right) for p in x.path)) for x in made)
    assert got == brute_manifest(rows, fanout)


def test_manifest_of_nothing_and_of_one_row(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    keep = {"doc_id": F.col("doc_id")}
    assert merkle.manifest(df.limit(0), FIELDS, "lang", "doc_id", keep).collect() == []
    one = merkle.manifest(df, FIELDS, "lang", "doc_id", keep).first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_manifest_query_sees_every_change(spark):
    for r in QUERIES["op12_merkle_manifest"](spark, DATA).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


# ---------------------------------------------------------------- chat windows

TURNS = "conv_id long, turn long, role string, text string, n_tokens long"


def brute_windows(turns, b):
    """(new texts, formatted) of one conversation's windows, each turn tried one after the other."""
    cost = [t[2] + b.markup for t in turns]
    system = next((k for k, t in enumerate(turns) if t[0] == "system"), None)
    out, new = [], 0
    while new < len(turns):
        low = new
        while low and sum(cost[low - 1:new]) <= b.history:
            low -= 1
        while True:
            front = system is not None and system < low
            room = b.window - (cost[system] if front else 0)
            if sum(cost[low:new + 1]) <= room or low == new:
                break
            low += 1
        end = new + 1
        while end < len(turns) and sum(cost[low:end + 1]) <= room:
            end += 1
        shown = ([system] if front else []) + list(range(low, end))
        out.append((list(range(new, end)), "".join(f"### {chat.escaped(turns[k][0])}: {chat.escaped(turns[k][1])}</turn>\n" for k in shown), len(shown)))
        new = end
    return out


def conversation(seed, n):
    r = random.Random(seed)
    turns = [("system" if k == seed % 3 else r.choice(["user", "assistant"]), r.choice(["</turn>", "\\e ### ", "plain \\", "é\n### user: "]) * r.randrange(4), r.randrange(90)) for k in range(n)]
    turns[n // 2] = ("assistant", "huge", 500)
    return turns


def test_windows_match_plain_packing(spark):
    b = chat.Budget(window=200, history=60)
    convs = {c: conversation(c, 5 + 9 * c) for c in range(6)}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, TURNS), b).orderBy("conv_id", "stretch", "number").collect()
    for c, turns in convs.items():
        want = brute_windows(turns, b)
        got = [w for w in made if w.conv_id == c]
        assert [w.text for w in got] == [t for _, t, _ in want]
        assert [w.n_turns - w.n_repeated for w in got] == [len(new) for new, _, _ in want]
        learned = [chat.unescaped(w.text[s.start:s.end]) for w in got for s in w.loss]
        assert learned == [t[1] for t in turns if t[0] == "assistant"]
        assert all(w.n_tokens <= b.window or w.n_turns - w.n_repeated == 1 for w in got)


def test_a_long_conversation_is_cut_into_stretches(spark):
    b = chat.Budget(window=200, history=60, stretch=700)
    turns = conversation(1, 300)
    rows = [(1, k, *t) for k, t in enumerate(turns)]
    made = chat.windows(spark.createDataFrame(rows, TURNS).repartition(7), b)
    got = made.orderBy("stretch", "number").collect()
    assert len({w.stretch for w in got}) > 10
    new = [x for w in got for x in chat.blocks(w.text)[w.n_repeated:]]
    assert new == [(t[0], t[1]) for t in turns]
    front = [chat.blocks(w.text)[0][0] for w in got[1:]]
    assert set(front) == {"system"}                                  # retained everywhere
    at, cost = 0, [t[2] + b.markup for t in turns]                     # history as over the whole conversation, cuts or not
    for w in got:
        room = b.window - (cost[1] if at > 1 else 0)
        low = at
        while low and sum(cost[low - 1:at]) <= b.history and sum(cost[low - 1:at + 1]) <= room:
            low -= 1
        if low > 1:
            assert w.n_repeated == 1 + at - low
        at += w.n_turns - w.n_repeated


def test_chat_of_odd_rows(spark):
    rows = [(None, 1, "user", "a", 3), (None, 2, "assistant", None, None), (5, None, "assistant", "", 0), (5, None, None, "x", 1), (5, 1, "a: b</turn>", "y", 1), (5, 1, "a: b</turn>", "y", 1),
            (6, 1, "assistant", "### z: </turn>\\" * 30_000, 90_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("kind", F.lit("clash")).withColumn("position", F.lit(9))
    made = {w.conv_id: w for w in chat.digests(chat.read_back(chat.windows(df))).collect()}
    assert {c: w.n_turns for c, w in made.items()} == {None: 2, 5: 4, 6: 1}
    assert made[5].turns_sha256 == SHA("\nx\nassistant\n\na: b</turn>\ny\na: b</turn>\ny\n")
    assert made[None].loss_chars == 0 and made[6].loss_sha256 == SHA(rows[-1][3]) and made[6].loss_chars == len(rows[-1][3])
    assert chat.windows(df.limit(0)).collect() == []


def test_chat_query_reads_back_what_was_said(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    said = "\\### Assistant: </turn> ok"
    convs = {-7: [("user", said), ("assistant", said)]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    want = {c: (len(t), SHA("".join(f"{a}\n{b}\n" for a, b in t)), sum(len(b) for a, b in t if a == "assistant"), SHA("".join(b for a, b in t if a == "assistant"))) for c, t in convs.items()}
    tokenizer = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    chars = {c: sum(len(f) for _, f, _ in brute_windows([(a, b, len(tokenizer.encode_ordinary(b))) for a, b in t], chat.Budget())) for c, t in convs.items()}
    got = QUERIES["op13_chat_formatting"](spark, DATA).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert {r.conv_id: r.formatted_chars for r in got} == chars


# ---------------------------------------------------------------- running positions

def test_positions_over_a_hot_group(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "a", "a", "b"]), r.randrange(50), r.randrange(9)) for _ in range(900)]
    got = frames.numbered(spark.createDataFrame(rows, "g string, o long, w long").repartition(5), "g", [F.col("o"), F.col("w")], "w").collect()
    for g in (None, "a", "b"):
        want, total = sorted(x[1:] for x in rows if x[0] == g), 0
        mine = sorted((x for x in got if x.g == g), key=lambda x: x.position)
        assert [(x.o, x.w) for x in mine] == want and [x.position for x in mine] == list(range(len(want)))
        for x in mine:
            assert x.before == total and x.total == len(want)
            total += x.w

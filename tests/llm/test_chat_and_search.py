"""Chat windows read back exactly; the index against brute force."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from filetwin.llm import multi_index
from filetwin.llm.chat import chat_windows, conversation_digests
from filetwin.llm.multi_index import search


def test_conversations_read_back(spark):
    odd = "a\\b <|im_end|>\n</s>[INST] ok [/INST] \\</s> <|im_start|>x"
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(1, 0, "system", "be kind"), (1, 1, "us\ner", odd), (1, 2, "assistant", odd), (1, 2, "assistant", odd)]
    rows += [(2, k, "assistant" if k % 2 else "user", f"word {k} " * (k % 60)) for k in range(600)]
    rows += [(3, None, None, None), (None, 1, "assistant", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows(talks.withColumn("window_id", F.lit("clash")), budget=400, stride=150, history=50)
    assert windows.where("tokens > 400 and not over_budget").count() == 0
    assert windows.where("conv_id = 2").count() > 20 and windows.where("array_contains(kinds, 1)").count() > 5
    got = {r.conv_id: r for r in conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        found = got[conv]
        assert found.n_turns == len(own) and found.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert found.loss_chars == len(learned) and found.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert conversation_digests(chat_windows(talks.limit(0))).count() == 0


def test_no_window_exceeds_the_budget_unless_one_turn_does(spark):
    dice = np.random.default_rng(4)
    word = lambda n: "w " * int(n)
    rows = [(1, 0, "system", word(600))] + [(1, k, ["assistant", "user"][k % 2], word(500)) for k in range(1, 10)]
    rows += [(2, 0, "system", word(300))] + [(2, k, ["assistant", "user"][k % 2], word(dice.integers(0, 700))) for k in range(1, 80)]
    rows += [(3, k, ["assistant", "user"][k % 2], word(dice.integers(0, 90))) for k in range(300)]
    rows += [(4, k, ["assistant", "user", "system"][k % 3], word(dice.integers(0, 1500))) for k in range(90)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    windows = chat_windows(talks, budget=1024, history=128)
    first = {1: 604, 2: 304, 3: 0, 4: len(rows[-88][3].split()) + 4}
    own = {}
    for r in windows.collect():
        turns = [len(p.split("\n", 1)[1].split()) + 4 for p in r.formatted.split("<|im_end|>\n")[:-1]]
        assert r.tokens == sum(turns) and r.over_budget == (r.tokens > 1024)
        mine = [t for t, kind in zip(turns, r.kinds) if kind == 2]
        own[r.conv_id] = own.get(r.conv_id, 0) + len(mine)
        if r.over_budget:
            assert len(mine) == 1 and first[r.conv_id] + mine[0] > 1024 and 1 not in r.kinds
        assert sum(t for t, kind in zip(turns, r.kinds) if kind == 1) <= 128
    assert own == {1: 10, 2: 80, 3: 300, 4: 90}
    assert windows.where("conv_id = 3").count() < 40 and windows.where("over_budget").count() > 5
    assert windows.where("conv_id = 3 and array_contains(kinds, 1)").count() > 10
    assert windows.where("conv_id = 2 and kinds[0] <> 0 and window_id > 1 and not array_contains(kinds, 0)").count() == 0


def test_search_finds_the_nearest(spark):
    dice = np.random.default_rng(0)
    points = dice.normal(size=(4000, 16))
    points[100:160] = points[100]
    rows = [(k, p.tolist()) for k, p in enumerate(points)]
    bad = [(10000, None), (10050, [0.0] * 16), (10100, [float("nan")] * 16), (10150, [1.0]), (10200, [None] * 16)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(4000), -np.round(near, 12)))[:5]
        hits += len({got[q][k][0] for k in range(1, 6)} & set(best.tolist()))
        assert all(abs(s - near[v]) < 1e-9 for v, s in got[q].values())
    assert len(got) == 80 and hits >= 0.9 * 400
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    assert search(table.limit(0), F.lit(True)).count() == 0


def test_search_spreads_over_groups_and_keeps_large_vectors(spark, monkeypatch):
    """Cells in several groups and cells of several blocks give what one group gives; sizes don't change cosines."""
    dice = np.random.default_rng(1)
    points = dice.normal(size=(3000, 8))
    points[500:900] = points[500]
    sizes = 10.0 ** dice.choice([-200, -3, 0, 3, 200], 3000)
    sizes[500:900] = 1e200
    table = lambda p: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "vec_id long, embedding array<double>")
    found = lambda t: {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in search(t, F.col("vec_id") % 50 == 0).collect()}
    whole = found(table(points))
    monkeypatch.setattr(multi_index, "BLOCK", 64)
    monkeypatch.setattr(multi_index, "GROUP", 200)
    assert len(whole) == 300 and found(table(points)) == whole
    assert [whole[500, r] for r in range(1, 6)] == [(501 + r, 1.0) for r in range(5)]
    large = found(table(points * sizes[:, None]))
    assert all(math.isfinite(score) for _, score in large.values()) and large == whole

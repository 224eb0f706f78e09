"""The operators over texts against brute force, with nulls, empty and long texts, ties and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filetwin import session
from filetwin.llm import class_lm, jaccard, pii, queries, suffix_array
from filetwin.llm.class_lm import score_texts
from filetwin.llm.common import crc_mod
from filetwin.llm.decontaminate import closest, drop_leaks, find_leaks
from filetwin.llm.jaccard import jaccard_components, keep_first_of_each
from filetwin.llm.language import keep_known_language, predict_language, train_language_model
from filetwin.llm.pack import Tokens, join_partial, pack, plan
from filetwin.llm.pii import find_pii, redact
from filetwin.llm.suffix_dedup import drop_repeated_strings
from filetwin.llm.window_dedup import drop_repeated_windows

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    out = []
    for group in range(8):
        base = [dice.choice(words) for _ in range(dice.choice([3, 8, 40, 120]))]
        for _ in range(dice.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(len(base) * dice.randrange(0, 6) // 100):
                copy[dice.randrange(len(copy))] = f"z{dice.randrange(10**6)}"
            out.append(" ".join(copy))
    passage = " ".join(dice.choice(words) for _ in range(60))
    out += [f"{' '.join(dice.choice(words) for _ in range(20))} {passage} {k}" for k in range(12)]
    out += [None, "", "  \n ", "A b", "a B", "é" * 400 + "x" * 5000, "abab " * 200, passage.upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", len(t or ""), "clash", "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_windows_against_brute_force(docs, texts):
    first = {}
    split = [re.findall(WORD, t or "") for t in texts]
    for d, w in enumerate(split):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    wanted = {}
    for d, w in enumerate(split):
        gone = {i for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for i in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeated_windows(docs).collect()}
    assert got == wanted and any(w[1] for w in wanted.values())


def test_strings_against_brute_force(docs, texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    wanted = {}
    for d, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        wanted[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    found = drop_repeated_strings(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == wanted


@pytest.mark.parametrize("wide", [3, 2048])
def test_suffix_array_sorts_suffixes(monkeypatch, wide):
    monkeypatch.setattr(suffix_array, "WIDE", wide)
    dice = random.Random(2)
    for _ in range(500):
        line = [dice.randrange(dice.choice([1, 2, 3, 8])) for _ in range(dice.randint(0, 50))]
        order = suffix_array.suffix_array(np.array(line, np.int64))
        assert order.tolist() == sorted(range(len(line)), key=lambda k: line[k:])


@pytest.mark.parametrize("block", [4, 1024])
def test_components_against_brute_force(monkeypatch, docs, texts, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = []
    for t in texts:
        w = re.findall(WORD, low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {d: (len(s), top(d)) for d, s in enumerate(sets)}
    if block == 1024:
        kept = keep_first_of_each(docs.unionByName(docs.where("doc_id in (0, 3, 9)")))
        assert sorted(r.doc_id for r in kept.collect()) == sorted({top(d) for d in range(len(sets))})
        assert kept.columns == docs.columns


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum((2 * x - 9 if x > 4 else 2 * x) if k % 2 else x for k, x in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data_against_brute_force(spark):
    dice = random.Random(3)
    parts = list("0123456789") * 3 + list("@..-+ abé😀()_%\n")
    parts += ["a@b.com", "4111 1111 1111 1111", "+49 170 1234567", "1.2.3.4"]
    rows = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 60))) for _ in range(600)]
    rows += [None, "", "a" * 50000, "1" * 50000, "a@b" + ".c" * 9000, "x@y.z " * 700, "clean words only"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    for d, text in enumerate(rows):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, text or "") if valid(k, m.group())]
        assert got[d].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[d].spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]
    left = {r.doc_id: r.text for r in redact(docs).collect()}
    assert left[len(rows) - 1] == "clean words only" and "@y.z" not in left[len(rows) - 2]


def test_a_term_that_only_one_entity_has_is_disclosing(spark):
    rows = [(k, "Zanzibar x@y.org the") for k in range(3)] + [(10 + k, "the other words the") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_term for r in find_pii(docs).collect()}[0] == 1
    assert redact(docs).where("doc_id = 1").first().text == " [EMAIL] the"


def test_language_is_learned_from_training_rows(spark):
    dice = random.Random(1)
    sounds = {"aa": ["la", "mi", "to"], "bb": ["krz", "szt", "ow"]}
    rows = []
    for k in range(400):
        lang = dice.choice(list(sounds))
        rows.append((k, " ".join("".join(dice.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "12 !", "aa"), (902, "lami", None), (903, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(docs, crc_mod("doc_id", 3) != 1)
    found = predict_language(docs, model, "doc_id", "lang").collect()
    assert all(r.lang_pred == r.lang for r in found if r.doc_id < 400) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {900, 901, 903}
    assert keep_known_language(docs, model).count() == 401
    untrained = train_language_model(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in predict_language(docs, untrained, "doc_id").collect()} == {"und"}


def test_leaks_with_edits_are_found_and_clean_texts_are_not(spark):
    dice = random.Random(4)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(dice.randint(15, 50))] for _ in range(30)]
    rows, wanted = [], set()
    for k in range(120):
        text = [word() for _ in range(80)]
        if k % 2:
            copy = list(items[k % 30])
            for _ in range(len(copy) // 10):
                copy[dice.randrange(len(copy))] = word()
            text[30:30] = copy
            wanted.add((k, k % 30))
        rows.append((k, " ".join(text).title()))
    rows += [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert found <= wanted and len(found) >= 0.95 * len(wanted)
    assert drop_leaks(docs, bench).count() == len(rows) - len({d for d, _ in found})
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert closest(np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 2, 4, 9], np.uint64), 1)[0] == 1


def test_packing_gives_every_id_once(spark, docs, texts):
    path = queries.tokenizer_path()
    encode = Tokens(path)
    ids = {d: np.frombuffer(encode(t), "<u4").tolist() + [0] for d, t in enumerate(texts)}
    assert all(encode(t) == np.array(encode.slow.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts)
    pieces, windows = {}, {}
    for r in pack(docs, path).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()
        assert sum(n for _, n in own) == len(ids[d])
    for own in windows.values():
        assert [s for s, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()
        assert sum(n for _, n in own) <= 1024


def test_at_most_one_window_of_a_block_is_not_full():
    dice = random.Random(6)
    for _ in range(50):
        lengths = [dice.randint(1, dice.choice([50, 900, 5000])) for _ in range(dice.randint(0, 60))]
        windows = join_partial(plan(lengths))
        assert sum(p[2] for w in windows for p in w[1]) == sum(lengths)
        assert sum(sum(p[2] for p in w[1]) < w[0] for w in windows) <= 1


def test_model_scores_and_base_against_brute_force(spark, docs, texts):
    tokens = [re.findall(WORD, low(t)) + [None] for t in texts]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d in range(len(texts))]
    counts = Counter(w for d, t in enumerate(tokens) if not held[d] for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for r in score_texts(docs, crc_mod("doc_id", 7) == 2, head=50, classes=6).collect():
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert r.base_score == pytest.approx(base) and r.score < 0 and r.held_out == held[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), total)


def test_empty_tables_give_empty_results(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for found in (
        drop_repeated_windows(empty),
        drop_repeated_strings(empty),
        jaccard_components(empty),
        find_pii(empty),
        redact(empty),
        find_leaks(empty, bench),
        pack(empty, queries.tokenizer_path()),
        score_texts(empty, F.lit(False)),
    ):
        assert found.count() == 0


def test_components_with_repeated_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "other")
    rows = [(2, long), (2, long), (2, "far off from all of these others here"), (5, near), (9, None), (None, long), (7, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == Counter(
        {(2, 56, 2): 2, (2, 4, 2): 1, (5, 56, 2): 1, (9, 0, 9): 1, (None, 56, None): 1, (7, 0, 7): 1}
    )


def test_exchange_reaches_words_beyond_the_head_and_the_dictionary(spark, monkeypatch):
    dice = random.Random(8)
    nouns, verbs = ([f"{c}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)] for c in "nv")
    rows = [(k, " ".join(dice.choice(side) for _ in range(20) for side in (nouns, verbs))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(class_lm, "DICTIONARY", 60)
    found = score_texts(docs, F.col("doc_id") % 7 == 2, head=40, classes=2).collect()
    # Two classes that take turns: a word costs one choice among 120, as all words have one shape.
    assert all(r.perplexity < 150 for r in found)


def test_rounds_leave_one_table_behind(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(class_lm, "materialize", lambda df, label: made.append(label) or session.materialize(df, label))
    dice = random.Random(9)
    rows = [(k, " ".join(dice.choice("abcdefghijklmnop") * dice.randint(1, 3) for _ in range(40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert score_texts(docs, F.col("doc_id") % 7 == 2, head=5, classes=3).count() == 60
    left = Counter(path.name.rsplit("-", 1)[0] for path in tmp_path.iterdir())
    # The classes that stay, and those of the round before if the last one had too few moves or was the last.
    assert made.count("lm-vectors") > 2 and left["lm-vectors"] == 0 and left["lm-classes"] <= 2
    assert left["lm-counts"] == left["lm-bigrams"] == left["lm-scored"] == 1


def test_classes_do_not_depend_on_which_words_are_in_the_dictionary(spark, monkeypatch):
    dice = random.Random(10)
    rows = [(k, " ".join(f"w{int(dice.expovariate(0.05))}" for _ in range(40)) + " same same") for k in range(80)] + [(80, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(class_lm, "mix", lambda x: np.asarray(x, np.uint64) * np.uint64(0))  # all words move in the same rounds
    found = []
    for size in (1000, 8):
        monkeypatch.setattr(class_lm, "DICTIONARY", size)
        found.append({r.doc_id: r for r in score_texts(docs, F.col("doc_id") % 7 == 2, head=5, classes=4).collect()})
    assert len(found[0]) == len(rows)
    for d, r in found[0].items():
        assert (found[1][d].n_tokens, found[1][d].n_known) == (r.n_tokens, r.n_known)
        assert found[1][d].base_score == pytest.approx(r.base_score) and found[1][d].score == pytest.approx(r.score)


def test_rounds_shuffle_rows_of_many_words(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(class_lm, "materialize", lambda df, label: rows.append((label, session.materialize(df, label))) or rows[-1][1])
    monkeypatch.setattr(class_lm, "discard", lambda table: None)
    monkeypatch.setattr(class_lm, "DICTIONARY", 50)
    texts = [(k, " ".join(f"w{(k * 31 + i * i) % 997}" for i in range(60))) for k in range(60)]
    score_texts(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") % 7 == 2, head=5, classes=3)
    assert all(table.count() <= 10 for label, table in rows if label in ("lm-vectors", "lm-classes"))


def test_gains_are_differences_of_the_likelihood():
    dice = np.random.default_rng(2)
    counts, of = dice.integers(0, 4, (12, 12)), dice.integers(0, 3, 12)

    def value(of):
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (of[:, None], of[None]), counts)
        left, right = pairs.sum(axis=1), np.array([counts.sum(axis=1)[of == c].sum() for c in range(3)])
        return class_lm._f(pairs).sum() - class_lm._f(left).sum() - class_lm._f(right).sum(), pairs

    member = np.eye(3)[of]
    got = class_lm.gains(value(of)[1], counts @ member, counts.T @ member, np.diag(counts).astype(float), of)
    for w in range(12):
        values = [value(np.where(np.arange(12) == w, c, of))[0] for c in range(3)]
        assert got[w] - got[w, of[w]] == pytest.approx(np.array(values) - values[of[w]])


def test_disclosing_terms_go_everywhere(spark):
    far = "the other words " * 40
    rows = [(k, f"x@y.org {far} Zanzibar") for k in range(3)] + [(10 + k, far) for k in range(30)]
    rows += [(50, "the Zanzibar words"), (51, None), (52, "once@only.org solitary")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_term, r.spans) for r in pii.find_pii(docs).collect()}
    assert got[0][0] == 1 and got[50] == (1, "term:4:12") and got[10] == got[51] == (0, "") and got[52][0] == 0
    left = {r.doc_id: r.text for r in redact(docs).collect()}
    assert left[0] == f"[EMAIL] {far} [NAME]" and left[50] == "the [NAME] words" and left[10] == far and left[51] is None
    assert [tuple(r) for r in pii.left_out(docs).collect()] == [("email", 2, 1)]

"""The Merkle manifest against a plain recomputation and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from filetwin.llm import manifest, queries
from filetwin.llm.manifest import audit, build_manifest, leaf_hash, prove, tampered_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, run string, key string"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def wanted(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in order:
        trees[source].sort(key=lambda x: x[:3])
        built[source] = levels([x[2] for x in trees[source]])
    top = levels([built[s][-1][0] for s in order])
    out = []
    for number, source in enumerate(order):
        for place, (_, _, own, row) in enumerate(trees[source]):
            fold = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"]:
                fold = leaf(row, row["text"].translate(LOW))
            proof = ""
            for tree, at in ((built[source], place), (top, number)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(h for k, h in enumerate(run) if k != slot)
                    fold = sha("".join(fold if k == slot else h for k, h in enumerate(run)))
                    at //= 16
            root = top[-1][0]
            out.append((row["doc_id"], own, built[source][-1][0], root, sha(proof), fold, fold == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def rows_of(sizes, dice):
    rows = []
    for source, size in sizes.items():
        for _ in range(size):
            text = dice.choice([None, "", "Abc É", "lower", "x" * 300_000 if not rows else "Long " * 5])
            number = dice.choice([None, dice.randrange(-5, 10**6), dice.randrange(40)])
            row = dict(doc_id=number, text=text, lang=dice.choice([None, "en"]), source=source, n_chars=dice.choice([None, 3]))
            rows.append(row | dict(tree=1, run="clash", key="clash"))
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 600, None: 40, "": 1, "é": 16, "B": 17, "b": 1},
        {f"s{k}": 1 + k % 3 for k in range(40)},
        {"only": 300},
        {"only": 1},
        {None: 2},
    ],
)
@pytest.mark.parametrize("heavy", [manifest.HEAVY, 3])
def test_against_recomputation(spark, monkeypatch, sizes, heavy):
    monkeypatch.setattr(manifest, "HEAVY", heavy)
    rows = rows_of(sizes, random.Random(len(sizes)))
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = ordered(tuple(r) for r in tampered_documents(docs.repartition(3)).collect())
    assert got == ordered(wanted(rows))


def test_repeated_rows_prove_themselves(spark):
    docs = spark.createDataFrame([(7, "Same", "en", "s", 4)] * 400, "doc_id long, text string, lang string, source string, n_chars long")
    got = audit(docs, F.lit(False), F.col("text")).collect()
    assert len(got) == 400 and all(r.verified for r in got) and len({r.leaf for r in got}) == 1


def test_a_forged_leaf_is_found(spark):
    docs = spark.createDataFrame([(k, f"T{k}", "en", "s", 2) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    own = F.when(F.col("doc_id") == 33, leaf_hash(lang=F.lit("de"))).otherwise(leaf_hash())
    proofs = prove(build_manifest(docs.select("source", "doc_id", leaf_hash().alias("leaf"), own.alias("own"))))
    assert [r.doc_id for r in proofs.where(~F.col("verified")).collect()] == [33]


def test_empty_table(spark):
    found = tampered_documents(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.collect() == []


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    told = connection.sql(queries.SQL["op11_merkle_manifest"])
    found = queries.op11_merkle_manifest(spark, folder)
    assert told.columns == found.columns
    assert ordered(told.fetchall()) == ordered(tuple(r) for r in found.collect())

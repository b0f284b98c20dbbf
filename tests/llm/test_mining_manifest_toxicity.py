"""Collocations, the Merkle manifest and toxicity against plain restatements, on small tables with nulls, odd texts and repeated rows."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodreach.llm import collocations, merkle, scan, toxicity
from tests.llm.test_llm import ODD, SCHEMA, documents, empty, prose


# op11

def _fold(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def _collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if any(q[0] == lang and len(q[1]) > len(w) and b >= a and any(q[1][i:i + len(w)] == w for i in range(len(q[1]) - len(w) + 1)) for q, b in candidates.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top])}


def _mined(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("share, lowered", [(0.5, 0.5), (0.02, 1.0), (1.0, 0.3), (0.0, 1.0)])
def test_collocations_equal_brute_force_whatever_the_sample(spark, share, lowered):
    texts = [*ODD, "New York city,  new\tYork City! new york city hall.", "a a a a a a a", "x x\nx x x", *[" ".join(w.rstrip("0123456789") for w in prose(i, 150).split()) for i in range(30)],
             *["only in copies the ship came in late; the ship came in late"] * 12]
    df = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 4 == 1, F.lit(None)).when(F.col("doc_id") % 4 == 2, "fr").otherwise("en"))
    rows = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
    assert _mined(df, min_count=5, top=40, share=share, lowered=lowered) == _collocations(rows, 5, 40)


def test_collocations_cut_long_texts_and_long_languages(spark, monkeypatch):
    texts = [prose(3, 900).replace("7", "") for _ in range(3)] + ["to be or not to be " * 200]
    df = documents(spark, texts, extra=False)
    want = _collocations([(r["lang"], r["text"]) for r in df.collect()], 3, 1000)
    data = np.frombuffer(texts[3].encode(), np.uint8)
    words = collocations._Words(data, np.array([0, len(data)]), np.zeros(1, np.uint64))
    monkeypatch.setattr(collocations, "BLOCK", 7)
    assert sum(own for _, own, _ in words.blocks()) == 1200 and all(seen <= 11 for _, _, seen in words.blocks())
    monkeypatch.undo()
    assert _mined(df, min_count=3, top=1000) == want
    assert _mined(empty(spark), min_count=3, top=10) == set()


def test_members_have_no_false_negatives(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    hashes = np.array([r[0] for r in df.collect()]).view(np.uint64)
    for limit in (1 << 12, 1 << 27):
        assert collocations.Members.of(df, limit).has(hashes).all()
    assert collocations.Members.of(df).has(scan.mix(hashes)).mean() < 0.05


# op12

def _h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, from the contract."""
    leaf = lambda r, text: _h(*[_field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        trees[s] = _levels([x[0] for x in groups[s]])
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for si, s in enumerate(order):
        for i, (own, r) in enumerate(groups[s]):
            struck = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node, siblings = leaf(r, r["text"].replace("\n", "")) if struck else own, []
            for levels, at in ((trees[s], i), (top, si)):
                for nodes in levels[:-1]:
                    first = at - at % 3
                    run = nodes[first:first + 3]
                    siblings += run[:at % 3] + run[at % 3 + 1:]
                    node = _h(*run[:at % 3], node, *run[at % 3 + 1:])
                    at //= 3
            out.append((r["doc_id"], own, trees[s][-1][0], top[-1][0], _h(*siblings), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_levels, n_sources, n", [(0, 4, 60), (1, 3, 100), (2, 1, 85), (1, 11, 70), (8, 3, 60), (1, 1, 1)])
def test_manifest_equals_brute_force(spark, part_levels, n_sources, n):
    texts = [*ODD, "with\na line\nor two", *[prose(i, 12) + ("\nend" if i % 2 else "") for i in range(n)]][-n:]
    df = documents(spark, texts, extra=n > 1).withColumn("source", F.when(F.col("doc_id") % 17 == 3, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("doc_id") * F.col("doc_id") % n_sources).cast("string"))))
    rows = df.select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = merkle.manifest(df, part_levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _manifest(rows)


def test_manifest_proofs_lead_to_the_root(spark):
    df = documents(spark, [prose(i, 9) for i in range(40)], extra=False)
    for r in merkle.manifest(df, 1, proofs=True).collect():
        assert len(r["proof"]) % 64 == 0 and hashlib.sha256(r["proof"].encode()).hexdigest() == r["proof_sha256"]
    assert merkle.manifest(empty(spark)).count() == 0


# op13

def test_risk_gradient_and_step_back():
    rng = np.random.default_rng(0)
    z, toxic = rng.normal(0, 1, 12), np.arange(12) < 4
    value, step = toxicity.risk(z, toxic, 0.2)
    for i in range(12):
        d = np.zeros(12)
        d[i] = 1e-6
        assert abs((toxicity.risk(z + d, toxic, 0.2)[0] - toxicity.risk(z - d, toxic, 0.2)[0]) / 2e-6 - step[i]) < 1e-6
    soft = lambda x: np.log1p(np.exp(x))
    assert abs(value - (0.2 * soft(-z[:4]).mean() + soft(z[4:]).mean() - 0.2 * soft(z[:4]).mean())) < 1e-9
    z = np.where(toxic, 30.0, -30.0)  # the negative risk is estimated below zero: the value leaves it out, the step undoes it
    value, step = toxicity.risk(z, toxic, 0.2)
    assert value < 1e-9 and (step[:4] > 0).all() and (step[4:] <= 0).all()


def test_toxicity_features_do_not_depend_on_neighbours():
    texts = [t or "" for t in ODD]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, at, value = toxicity.vectors(data, offsets)
    for i, r in enumerate(raw):
        _, a, v = toxicity.vectors(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.array_equal(at[row == i], a) and np.allclose(value[row == i], v)
    n = len(toxicity.features(np.frombuffer("ñandú ab".encode(), np.uint8), np.array([0, 9 + 1]))[0])
    assert n == 2 + 3 + 2 + 1  # two words; of five characters three runs of 3, two of 4, one of 5


def _toxic_corpus(spark):
    rng = np.random.default_rng(4)
    bad = ["vilewort", "grumscum", "nastoid"]
    texts, labels = [], []
    for i in range(900):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words[rng.integers(0, 60)] = bad[rng.integers(0, 3)] + "sxy"[rng.integers(0, 3)]
        texts.append(" ".join(words))
        if i % 7 < 4:  # as often toxic as the rest: the prior is learned from them
            labels.append((i, int(toxic)))
    labels += [(5000, 1), (None, 1), (7, None)]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_is_learned_from_toxic_and_unlabelled_text(spark):
    docs, labels = _toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).filter("doc_id is not null").collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    toxic = [i for i in held if i % 6 == 0]
    assert np.mean([got[i]["predicted"] for i in toxic]) > 0.9
    assert np.mean([got[i]["predicted"] for i in held if i % 6]) < 0.03
    # Held-out labels change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.judge(docs, other).filter("doc_id is not null").collect()}
    assert all(again[i] == got[i]["score"] for i in range(900))


def test_toxicity_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = documents(spark, ODD)
    assert {round(r["score"], 9) for r in toxicity.judge(docs, none).collect()} == {toxicity.DEFAULT_PRIOR}
    assert toxicity.judge(empty(spark), none).count() == 0
    assert SCHEMA.startswith("doc_id")


def test_collocations_tell_a_phrase_less_than_once_a_task(spark):
    """48 pairs of words, each in 100 of 4,800 documents and in each of 32 tasks: before, every task told every phrase; a language the sample lacks is told too."""
    from tests.test_findings_r03 import _most_shuffled
    docs = spark.range(0, 4800, 1, 32).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.format_string("left%d right%d", F.col("id") % 48, F.col("id") % 48).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, "fr", "le mot") for i in range(3)], docs.schema))
    counted = collocations.count_pass(docs, collocations.Members(np.full(1 << 10, ~np.uint64(0))), []).filter("k = 0 or n >= 100").localCheckpoint()
    assert counted.count() == 2 + 3 * 48
    got, most = _most_shuffled(spark, lambda: {tuple(r) for r in collocations.spelt(docs, counted).collect()})
    pairs = {("en", k, p, 100) for i in range(48) for k, p in ((1, f"left{i}"), (1, f"right{i}"), (2, f"left{i} right{i}"))}
    assert got == pairs | {("en", 0, "", 9600), ("fr", 0, "", 6)} and most < 12 * 3 * 48

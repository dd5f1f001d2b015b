"""Queries that SQL can't express, held against plain Python over whole tables."""

import difflib
import hashlib
import os
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry
from corvane.operators import structure as C

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.registry.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def hashed(words: list[str], n: int = 8) -> set[int]:
    """Distinct shingle hashes: each word hashed, the hashes chained."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]
    out = set()
    for i in range(len(of) - n + 1):
        h = 42
        for x in of[i : i + n]:
            h = xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=h).intdigest()
        out.add(signed(h))
    return out


def test_sampled_shingles(run, documents):
    want = {}
    for k, t in documents.items():
        n = sum(h % 8 == 0 for h in hashed(re.findall("[a-z0-9]+", t.lower())))
        if n:
            want[k] = n
    assert {r.doc_id: r.n for r in run("d01_sampled_shingles")} == want


def test_mended_words(run, documents):
    broken = {k: re.sub(r"\b([a-z]{3})([a-z]{3,})\b", r"\1- \2", t) for k, t in documents.items()}
    functions, prefixes = set(C.FUNCTION_WORDS), set(C.PREFIXES)
    for r in run("x08_mended_words"):
        t = broken[r.doc_id]
        known = Counter(re.findall("[a-z]+", re.sub(r"\w+- \w+", " ", t).lower()))

        def decide(m):
            left, right = m[1].lower(), m[2]
            if left in functions or right in functions:
                return f"{m[1]} – {right}"
            if known[left + right]:  # noqa: B023
                return m[1] + right
            return f"{m[1]}-{right}" if left in prefixes or known[right] else m[1] + right  # noqa: B023

        want = re.sub(r"\b([A-Za-z]{2,})- (?!(?:and|or|to|nor|versus|vs)\b)([a-z]{2,})\b", decide, " ".join(t.split()))
        assert r.text == want


def test_embeddings(run, documents):
    got = {r.doc_id: (r.dim, r.norm) for r in run("v01_embed")}
    assert got == {k: (64, 1.0 if re.search("[a-z0-9]", t.lower()) else 0.0) for k, t in documents.items()}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_rouge_l(run, spark):
    from corvane.plans.stand_ins import pairs

    want = {}
    for r in pairs(spark, DATA).collect():
        a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (r.answer, r.question))
        c = lcs(a, b)
        want[r.qa_id] = 2 * c / (len(a) + len(b)) if c else 0.0
    got = {r.qa_id: r for r in run("m05_rouge_l")}
    column = next(c for c in next(iter(got.values())).asDict() if c != "qa_id")
    assert set(got) == set(want) and all(got[k][column] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_title_ratios(run, spark):
    titles = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        t = re.search("(?is)<title[^>]*>(.*?)</title", r.html)
        titles[r.page_id] = " ".join(re.sub("[^a-z0-9 ]+", " ", t[1].replace("_", " ").lower()).split()) if t else ""
    got = {r.page_id: r.ratio for r in run("x27_title_ratio")}
    for k, ratio in got.items():
        assert ratio == pytest.approx(difflib.SequenceMatcher(None, titles[k], titles[k + 1]).ratio())
    assert len(got) == sum(len(titles[k]) >= 12 and len(titles.get(k + 1, "")) >= 12 for k in titles)


def test_similar_titles(run, spark):
    titles = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        t = re.search("(?is)<title[^>]*>(.*?)</title", r.html)
        titles[r.page_id] = " ".join(re.sub("[^a-z0-9 ]+", " ", t[1].replace("_", " ").lower()).split()) if t else ""
    ids = sorted(k for k, t in titles.items() if len(t) >= 12)
    want = {(a, b): difflib.SequenceMatcher(None, titles[a], titles[b]).ratio() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    assert {(r.a, r.b): pytest.approx(r.ratio) for r in run("d04_similar_titles")} == {k: v for k, v in want.items() if v >= 0.9}


def test_units_and_pairs(run, documents):
    end = re.compile(r'(?<=[.!?])\s+(?=[A-Z0-9"“(])')
    complete = re.compile(r"[.!?][\"”’')\]]*(?:\s*\[\d+(?:\s*[,–-]\s*\d+)*\])?$")
    want = {}
    for k, t in documents.items():
        fit = [s for s in end.split(t.strip(" ")) if s.strip(" ") and len(s) >= 20 and complete.search(" ".join(s.split()))]
        want |= {f"{k}:u{n + 1:02d}": s for n, s in enumerate(fit[:8])}
    got = run("l07_units_per_chunk")
    assert {r.unit_id: r.unit for r in got} == want and all(r.evidence_valid for r in got)
    assert {r.qa_id: r.answer for r in run("l08_pairs_per_chunk")} == {f"{k.split(':u')[0]}:q{int(k.split(':u')[1])}": s for k, s in want.items() if int(k.split(":u")[1]) <= 3}


def test_bootstrap_of_cells(spark):
    """An interval holds the mean, and is about as wide as the normal one."""
    from corvane.functions import stats as S

    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.normal(5, 2, 400)] + [("b", None), ("b", 1.0)]
    got = {r.g: r for r in S.boot_ci(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    x = np.array([v for g, v in rows if g == "a"])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert got["a"].n == 400 and got["a"].mean == pytest.approx(x.mean()) and got["a"].lo == pytest.approx(x.mean() - half, abs=0.05) and got["a"].hi == pytest.approx(x.mean() + half, abs=0.05)
    assert (got["b"].n, got["b"].lo, got["b"].hi) == (1, 1.0, 1.0)


def test_splits_cover_or_miss_fewest(run):
    rows = run("z14_covering_splits")
    assert {"train", "test_heldout_docs"} <= {r.split for r in rows} <= {"train", "val", "test_indomain", "test_heldout_docs"} and len({(r.seed, r.missing) for r in rows}) == 1


def test_judged_and_repaired(run, spark):
    from corvane.operators import scoring
    from corvane.plans.stand_ins import pairs

    rows = pairs(spark, DATA).withColumn("banned", scoring.banned("question").isNotNull()).withColumn("again", scoring.banned("question").isNotNull()).collect()

    def fails(q, a):
        return [n for n, bad in (("grounding", len(q) % 5 + 1 < 4), ("not_standalone", len(a) % 3 == 0), ("low_value", len(a) % 5 + 1 < 3), ("garbled_question", len(q) % 11 == 0)) if bad]

    want = Counter()
    for r in rows:
        first = fails(r.question, r.answer)
        if r.banned:
            want["rejected"] += 1
        elif not first:
            want["passed"] += 1
        elif "low_value" in first or not {"grounding", "not_standalone"} & set(first):
            want["rejected"] += 1
        else:
            want["rejected" if fails("Repaired: " + r.question, r.answer) else "repaired"] += 1
    assert {r.status: r.n for r in run("l10_judged_and_repaired")} == dict(want)


def test_cached_completions(run, spark):
    from corvane.operators import models as M
    from corvane.plans.stand_ins import pairs

    asked = {r.question for r in pairs(spark, DATA).select("question").collect()}
    got = run("l01_cached_completion")
    assert sorted(r.answer for r in got) == sorted(M.echo(sorted(asked))) and {r.cached for r in got} == {True, False} and all(r.cached == (r.key < "8") for r in got)
    assert len({r.key for r in got}) == len(got) and all(re.fullmatch("[0-9a-f]{64}", r.key) for r in got) and hashlib is not None


def test_signals_with_lookaround(run, documents):
    from corvane.operators import scoring

    rules = {f"n_{k}": re.compile(scoring.SIGNALS[k][0]) for k in ("number", "percent_or_stat")}
    for r in run("x17_signals_with_lookaround"):
        assert all(r[k] == sum(1 for _ in rx.finditer(documents[r.doc_id])) for k, rx in rules.items())


def test_banned_phrases(run, spark):
    from corvane.operators import scoring

    banned = re.compile(r"\b(?:" + "|".join(f"(?:{p})" for p in scoring.BANNED) + ")", re.I)
    meta = re.compile("|".join(f"(?:{p})" for p in scoring.META), re.I)
    from corvane.plans.stand_ins import pairs

    asked = {r.qa_id: f"What does {'a policy' if r.qa_id % 2 else 'the evidence'} say on {r.question}" for r in pairs(spark, DATA).collect()}
    first = lambda rx, t: m[0] if (m := rx.search(t)) else None
    assert {r.qa_id: (r.banned, r.meta) for r in run("x19_banned_phrases")} == {k: (first(banned, t), first(meta, t)) for k, t in asked.items()}


def test_exact_reproduction(run, spark):
    from corvane.plans.stand_ins import pairs

    def near(a, b):
        x, y = (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))
        return bool(x and y) and 2 * lcs(x, y) / (len(x) + len(y)) >= 0.8

    want = {r.qa_id: near(r.question if r.qa_id % 2 else r.answer, r.answer) for r in pairs(spark, DATA).collect()}
    assert {r.qa_id: r.reproduced for r in run("m06_exact_reproduction")} == want


def test_paraphrases(run, spark):
    from corvane.operators import scoring
    from corvane.plans.stand_ins import pairs

    banned = re.compile(r"\b(?:" + "|".join(f"(?:{p})" for p in scoring.BANNED) + ")", re.I)
    want = {}
    for r in pairs(spark, DATA).collect():
        ok = lambda x: not banned.search(x) and r.question[:10] in x  # noqa: B023, E731
        made = [f"In short: {r.question}", f"As noted in the text, {r.question}", f"Say {r.answer}"]
        bad = [x for x in made if not ok(x)]
        again = [x for x in (f"Please tell: {b}" for b in bad) if ok(x)]
        want[r.qa_id] = ([x for x in made if ok(x)] + again, len(bad), len(bad) - len(again))
    assert {r.qa_id: (r.paraphrases, r.n_bad, r.n_dropped) for r in run("l11_paraphrases_fixed")} == want


def test_reranked(run, spark, documents):
    """The five best of BM25's ten by the share of the question's words that the text holds; BM25 in plain Python."""
    texts = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in documents.items()}
    texts = {k: w for k, w in texts.items() if w}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    counts = {k: Counter(w) for k, w in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    want = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        asked = set(re.findall("[a-z0-9]+", r.text.lower()))
        score = {}
        for k, c in counts.items():
            if asked & c.keys():
                score[k] = round(sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(texts[k]) / mean)) for t in asked if c[t]), 6)
        top = sorted(score, key=lambda k: (-score[k], k))[:10]
        share = {k: len(asked & counts[k].keys()) / max(len(asked), 1) for k in top}
        want |= {(r.item_id, k, i + 1) for i, k in enumerate(sorted(top, key=lambda k: (-share[k], k))[:5])}
    assert {tuple(r) for r in run("r04_rerank")} == want


def test_packed_chunks_hold_every_block_once(run, spark):
    from corvane.plans.stand_ins import blocks

    own = {(b.doc_id, b.block_id): b for b in blocks(spark, DATA).where("not skip").collect()}
    seen, last = Counter(), {}
    for c in sorted(run("c12_packed_chunks"), key=lambda c: (c.doc_id, c.n)):
        assert c.n == last.get(c.doc_id, -1) + 1 and c.chunk_id == f"{c.doc_id}:{c.n:04d}"
        last[c.doc_id] = c.n
        rows = [own[c.doc_id, k] for k in dict.fromkeys(c.block_ids)]
        assert len({r.section_path[0] for r in rows}) == 1 and (c.page_start, c.page_end) == (min(r.page for r in rows), max(r.page for r in rows))
        assert c.n_tokens == len(c.text.split()) and (c.overlap_tokens == 0 or c.overlap_tokens <= 12)
        body = c.text.split("\n\n", 1)[1] if c.overlap_tokens else c.text
        if not c.split_paragraph:
            assert body == "\n\n".join(r.text for r in rows)
            seen.update((c.doc_id, k) for k in c.block_ids)
        else:
            seen.update((c.doc_id, k) for k in set(c.block_ids) if own[c.doc_id, k].type == "table" or len(own[c.doc_id, k].text.split()) <= 130)
    assert seen == Counter(k for k, b in own.items() if b.type == "table" or len(b.text.split()) <= 130)

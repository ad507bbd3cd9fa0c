"""The pipeline, stage by stage, against brute force, and its edge cases."""

import random

import pytest
from test_pairs import brute_fingerprint, least_reachable
from test_texts import ENGLISH, FRENCH, GERMAN, WORD, brute_decontaminate, brute_substrings, fold

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string, declared string, own long, hit string"


def made():
    rng, rows = random.Random(12), []
    shared = " ".join(f"teilen{k} the" for k in range(30))
    leak = "What is the capital city of the country that lies north of here"
    for i in range(60):
        text, lang = [(ENGLISH, "en"), (GERMAN, "de"), (FRENCH, "fr")][i % 3]
        words = [w for _ in range(rng.randint(3, 12)) for w in rng.sample(text.split(), 15)]
        body = " ".join(f"{w}{rng.randrange(50)}" if rng.random() < 0.3 else w for w in words)
        if i % 7 == 0:
            body += f"\n{shared}\n" + " ".join(rng.sample(text.split(), 10))
        if i % 11 == 0:
            body += f" {leak}, they ask. "
        rows.append((i, body, lang, f"src{i % 4}", len(body)))
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(800)) + " " + ENGLISH
    rows += [(70, rows[3][1], "en", None, 5), (71, rows[3][1], None, "src1", None), (72, long, "en", "src0", 1), (73, long + " end", "en", "src0", 1)]
    rows += [(80, None, "en", "src0", None), (81, "", "de", "src0", 0), (82, "12 34 56", "en", "src1", 8), (5, rows[5][1], "fr", "src1", rows[5][4])]
    rows = [(*r, k, f"x{k}", "de", None, "y") for k, r in enumerate(rows)]  # columns of names that the operators use, too
    return rows, [(1, leak), (2, None), (3, "unrelated text of no more than ten words")]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    rows, bench = made()
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/out-{name}")
        docs = spark.read.parquet(f"{sf}/out-{name}")
        out[name] = docs
    return sf, out, rows, bench


def test_language_keeps_what_is_in_a_language(staged):
    _, out, rows, _ = staged
    got = sorted(r["doc_id"] for r in out["language"].collect())
    assert got == sorted(r[0] for r in rows if r[0] not in (80, 81, 82))


def test_one_of_each_group_of_near_duplicates_stays(staged):
    _, out, rows, _ = staged
    given = {r["doc_id"]: r["text"] for r in out["language"].collect()}
    fp = {i: brute_fingerprint(t) for i, t in given.items()}
    first = least_reachable(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert first[70] == first[71] == 3
    assert sorted(r["doc_id"] for r in out["near_duplicates"].collect()) == sorted(set(first.values()))


def test_repeated_passages_go(staged):
    _, out, _, _ = staged
    given = {r["doc_id"]: r["text"] for r in out["near_duplicates"].collect()}
    got = {r["doc_id"]: r for r in out["substrings"].collect()}
    assert set(got) == set(given)
    import hashlib

    for (i, t), (_, removed, sha) in zip(given.items(), brute_substrings(list(given.values()))):
        words = WORD.findall(got[i]["text"])
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == sha
        assert got[i]["n_chars"] == len(got[i]["text"]) and (removed or got[i]["text"] == t)
    assert any("teilen3" in t for t in given.values()) and not any("teilen3 the teilen4" in r["text"] for r in got.values())


def test_benchmark_passages_go(staged):
    _, out, _, bench = staged
    given = {r["doc_id"]: r["text"] for r in out["substrings"].collect()}
    got = {r["doc_id"]: r["text"] for r in out["decontamination"].collect()}
    assert set(got) == set(given)
    n = 0
    for i, (total, hit, *_) in zip(given, brute_decontaminate(list(given.values()), bench)):
        assert len(fold(got[i])) == total - hit and (hit or got[i] == given[i])
        n += hit > 0
    assert n >= 3


def test_every_document_is_packed(staged, spark):
    sf, out, _, _ = staged
    got = {}
    for r in out["packing"].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= r["start"] + r["length"]
    assert set(got) == {r["doc_id"] for r in out["decontamination"].collect()}
    again = corpus_pipeline.run(spark, sf)
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(again.collect()) == key(out["packing"].collect())


def test_columns_stay_and_empty_tables_pass(staged, spark):
    sf, out, _, _ = staged
    want = [c.split()[0] for c in COLUMNS.split(", ")]
    assert all(out[name].columns == want for name, _ in corpus_pipeline.STAGES[:-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0

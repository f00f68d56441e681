import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlight.llm import quality, token_counts
from kinlight.llm import queries as Q

from .test_alike import alike, plain_set
from .test_dedup import components, norm, plain_removal, plain_simhash
from .test_text_models import plain_best_fit, plain_shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_stages_match_plain_versions(spark, tables, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs, kept = tables["documents"], {}
    columns = docs.columns
    # rows that odd tables have: none of them may break a stage
    odd = spark.createDataFrame([(900, None), (901, ""), (902, ""), (None, "of the in"), (3, "of the in")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    docs = docs.unionByName(odd)
    kept["start"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.collect()

    def pairs(rows):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in rows)

    start = spark.createDataFrame([(r.doc_id, r.text) for r in kept["start"]], "doc_id long, text string")
    forest = quality.train(start, tables["labels"])
    good = {(r.doc_id, r.text_key) for r in quality.score(start, forest).filter("predicted = 1").collect()}
    keyed = start.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert pairs(kept["quality"]) == pairs([r for r in keyed if (r.doc_id, r.text_key) in good])

    def order(r):
        return (r.doc_id is None, r.doc_id or 0)

    first = {}
    for r in sorted(kept["quality"], key=order):
        first.setdefault(norm(r.text), r)
    assert pairs(kept["exact_dedup"]) == pairs(first.values())

    rows = [r for r in kept["exact_dedup"]]
    fps, sets = [plain_simhash(r.text) for r in rows], [plain_set(r.text) for r in rows]
    at = components(fps, [10**9 if r.doc_id is None else r.doc_id for r in rows], 4)
    near = [(at[i], at[j]) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    name = {c: c for c in at}
    for _ in name:
        for i, j in near:
            i, j = name[i], name[j]
            name = {c: min(i, j) if x in (i, j) else x for c, x in name.items()}
    assert any((fps[i] ^ fps[j]).bit_count() > 4 for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept["near_dedup"]) == sorted(-1 if c == 10**9 else c for c in set(name.values()))

    items = [s for s in (plain_shingles(r.text) for r in tables["benchmark"].collect()) if s]
    clean = [r for r in kept["near_dedup"] if r.doc_id is None or not any(len(s & plain_shingles(r.text)) / len(s) >= 0.8 for s in items)]
    assert pairs(kept["decontamination"]) == pairs(clean) and len(clean) < len(kept["near_dedup"])

    tokenizer = token_counts.load_tokenizer(Q.public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in kept["decontamination"]:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(-1 if r.doc_id is None else r.doc_id, k // 4096, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept["packing"]) == sorted(want)
    assert len({r.sequence_id for r in kept["packing"]}) == len(plain_best_fit([w[2] for w in want], 4096))


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 100


def test_stages_on_empty_tables(spark, tables):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, tables["documents"].limit(0), FOLDER).count() == 0, name


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    found = Q.QUERIES[name](spark, FOLDER)
    n = found.count()
    assert n == {"op9_html_extraction": 50}.get(name, n) and (n >= 200 or name in ("op6_decontamination", "op9_html_extraction", "op11_conversation_repair"))


def test_shapes(spark):
    want = {
        "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
        "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        "op8_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op9_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
        "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
        "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
        "op13_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    }
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in Q.QUERIES[name](spark, FOLDER).dtypes) == columns, name


def test_removed_words_on_documents(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    import hashlib

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op8_substring_dedup(spark, FOLDER).collect()}
    assert got == {d: (n, gone, hashlib.sha256(left.encode()).hexdigest()) for d, n, gone, left in plain_removal(rows)}


def test_no_module_reads_files_of_the_machine():
    from pathlib import Path

    for path in Path(Q.__file__).parent.glob("*.py"):
        # a tree of reduces, as whitening merges moments in, is the RDD's
        text = path.read_text() if path.name != "whitening.py" else path.read_text().replace(".rdd.map(", "")
        assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b|open\(|tempfile", text), path

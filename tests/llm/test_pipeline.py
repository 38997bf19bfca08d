import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from tests.conftest import SF001
from tests.llm import test_decontaminate, test_mixing, test_simhash
from velora.llm import toxicity


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_registered():
    q = E.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "token files"]


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(P.STAGES)

    kept = stages["toxicity"](spark, docs, SF001)
    assert kept.columns == docs.columns
    hit = {r.doc_id for r in toxicity.toxicity_report(docs, labels).collect() if r.toxic}
    assert hit and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in hit)

    before = rows_of(kept)
    kept = stages["near duplicates"](spark, kept, SF001)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in rows_of(kept)) == sorted({c for _, _, c in test_simhash.slow_components(before)})

    before = rows_of(kept)
    kept = stages["decontamination"](spark, kept, SF001)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in rows_of(kept)) == sorted(x[0] for x in test_decontaminate.slow(before, bench) if not x[5])

    before = [(r.doc_id, r.text, r.lang, r.source) for r in kept.collect()]
    kept = stages["mixing"](spark, kept, SF001)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in rows_of(kept)) == sorted(x[0] for x in test_mixing.slow(before, P.MIXTURE))

    tok = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    at, want = 0, []
    for d, t in sorted(rows_of(kept)):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in stages["token files"](spark, kept, SF001).collect()) == want
    assert sorted(tuple(r) for r in P.run(spark, SF001).collect()) == want


def test_stages_take_nulls_repeats_extra_columns_and_empty_tables(spark):
    from tests.llm.helpers import docs

    text = "plain words of a clean document " * 8
    rows = [(i, f"{text}{i} {i * 7} {i * 13}", "en", f"src{i % 3}") for i in range(20)]
    rows += [(None, None), (50, None, "de", "src1"), (51, "", None, None), (3, *rows[3][1:]), (None, "no id here", "en", "src2"), (52, "long " * 200_000)]
    for frame in (docs(spark, rows, extra=["epoch", "fp", "match"]), docs(spark, [])):
        kept = frame
        for name, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, SF001)
            assert kept.columns == frame.columns, name
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        n = kept.count()
        assert P.STAGES[-1][1](spark, kept, SF001).count() == n
        assert (n > 10) == bool(frame.count())

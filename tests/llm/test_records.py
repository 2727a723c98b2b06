"""WARC archives, preference pairs and the pipeline."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hopgrid.llm import decontaminate, pii, preference, queries, warc
from hopgrid.llm.text import chunks
from tests.llm import brute
from tests.llm.conftest import SF, pairs, rows
from tests.llm.held_out import lines
from tests.llm.test_text_operators import plain_verdicts
from tests.oracle import same

EVIL = "x" * 600 + "WARC/1.1\r\nContent-Length: 10\r\n\r\nabcdefghij\r\n\r\n" * 20


def pages(spark):
    data = [(i, f"http://h/{i}\r\nX: y", EVIL + str(i % 3) if i % 2 else None, i) for i in range(60)]
    data += [(None, None, EVIL + "0", 1), (5, None, EVIL + "2", 2), (5, None, EVIL + "2", 2), (70, "http://" + "a" * 70_000, "é" * 499, 3), (71, "", "é" * 499, 3), (72, "", "é" * 500, 3), (73, "", "é" * 500, 3)]
    return spark.createDataFrame(data, "page_id long, url string, html string, digest int")


def expected(data):
    best, out = {}, []
    for p, html in data:
        b = (html or "").encode()
        if len(b) >= 1000 and p is not None:
            best[b] = max(best.get(b, p), p)
    for p, html in data:
        b = (html or "").encode()
        keep = best.get(b)
        revisit = len(b) >= 1000 and keep is not None and keep != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [700, 4096, warc.BLOCK_BYTES])
@pytest.mark.parametrize("rows_", [0, warc.BROADCAST_ROWS])
def test_round_trip(spark, block, rows_, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows_)
    df = pages(spark)
    archives = warc.write(df)
    want = expected([(r["page_id"], r["html"]) for r in df.collect()])
    back = warc.read(archives, block)
    assert rows(back.drop("payload")) == want
    for r in back.collect():
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    warc.drop(archives)


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = pages(spark).coalesce(1)
    assert rows(warc.round_trip(df)) == expected([(r["page_id"], r["html"]) for r in df.collect()])


def test_empty_pages(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_broken_chain_is_an_error(spark, tmp_path):
    raw = warc.record(1, "http://a", b"abc", "d", None)
    (tmp_path / "a.warc").write_bytes(raw + raw[:-9])
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc", 2 * len(raw) - 9, 2)], "file string, size long, n long")
    with pytest.raises(Exception):
        warc.read(archives).collect()


def turns(spark):
    data = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo<|im_end|>"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, None, None, None), (4, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "é🙂"), (None, 0, "a", "b"), (9, 0, "user", "x"), (10, 0, "user", "hi"), (10, 1, "assistant", "yo"), (11, 0, "user", "hi"), (11, 1, "assistant", "no"), (11, 1, "assistant", "no"), (12, 0, "user", "z" * 200_000), (13, 0, "user", "z" * 200_000)]
    return spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, pair_id string")


def test_preference_edges(spark):
    import duckdb

    df = turns(spark)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    same(preference.neighbours(df), con, queries.OP7_SQL)
    by = {r["pair_id"]: r for r in preference.neighbours(df).collect()}
    assert by[5]["n_prompt_turns"] == 1 and by[2]["chosen"] == "" and by[6]["n_prompt_turns"] == 1
    for r in by.values():
        for side in ("chosen", "rejected"):
            for span in filter(None, r[f"{side}_loss"].split(",")):
                s, e = map(int, span.split(":"))
                assert r[side][s:e].endswith("<|im_end|>") and r[side][:s].endswith("assistant\n")
    assert preference.neighbours(df.limit(0)).count() == 0


def plain_pipeline(spark, docs):
    """The stages one after another on Python lists."""
    kept = {d for d, sure in plain_verdicts(spark, SF) if sure}
    rows_ = [(d, t) for d, t in pairs(docs) if d in kept]
    rows_ = [(d, t) for (d, t), (_, _, c) in zip(rows_, brute.components(rows_, corpus_pipeline.NEAR_BITS, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PRINTS)) if d == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows_ = [x for x, y in zip(rows_, brute.contamination(rows_, items)) if not y[-1]]
    texts = [brute.redacted(t, brute.personal(t) + brute.field_spans(pii.field(), t)) for _, t in rows_]
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    return sorted(((d, len(x), brute.sha(np.array(x, "<u4").tobytes()), brute.sha(t.decode(x, skip_special_tokens=False))) for (d, _), x in zip(rows_, ids)), key=repr)


def test_field_spans_match_plain():
    for _, text, _ in lines():
        (c,) = chunks(pa.array([text + "\n" + text[::-1]]))
        got = [(pii.KINDS[k], s, e) for _, _, every in pii.find_spans(c) for s, k, e in every if k > 3]
        assert sorted(got) == sorted(brute.field_spans(pii.field(), text + "\n" + text[::-1]))


def test_run_leaves_one_folder(spark, tmp_path):
    """The stored tables of the stages are deleted; the last stage's documents stay."""
    import os

    from hopgrid.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:").replace("///", "/")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF)
    new = {x for x in set(os.listdir(folder)) - before if x.startswith(("table-", "pipeline-"))}
    assert len(new) == 1 and new.pop().endswith("pii")


def test_pipeline(spark, documents):
    out = corpus_pipeline.run(spark, SF)
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == plain_pipeline(spark, documents)


@pytest.mark.parametrize("name", ["edges", "empty"])
def test_stages_on_edges(spark, name, request):
    docs = request.getfixturevalue(name)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        assert out.count() <= docs.count()


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)
    assert decontaminate.WINDOW == 13

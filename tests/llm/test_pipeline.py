"""The pipeline against plain versions of its stages."""

import os

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kinetext.llm import common, decontaminate


def plain_cut(text, items):
    at, _ = brute.hits(text, items)
    words = brute.words(text)
    if words and len(at) > 0.5 * len(words):
        return None
    spans = decontaminate.merge([[p, p] for p in at])
    return decontaminate.cut(text.encode(), spans).decode() if spans else text


def test_stages_match_plain_versions(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw = before
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, sf), name)
        rows = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r["doc_id"]: r["text"] for r in rows}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "language_id":
            assert all(after[d] == before[d] for d in after)
            assert len(after) >= 0.97 * len(before)  # these documents are all in a known language
        elif name == "line_dedup":
            assert after == {d: x for d, _, n, x in brute.line_dedup(sorted(before.items())) if n == 0 or x.strip(brute.BLANK)}
        elif name == "simhash_near_dedup":
            links = [brute.components({d: brute.fingerprint(texts[d]) for d in before}) for texts in (before, raw)]
            group = {d: d for d in before}
            while (new := {d: min(group[x] for own in links for x in before if own[x] == own[d]) for d in before}) != group:
                group = new
            assert after == {d: x for d, x in before.items() if group[d] == d}
        elif name == "benchmark_decontamination":
            assert after == {d: y for d, x in before.items() for y in [plain_cut(x, items)] if y is not None}
        else:
            assert {r["doc_id"]: list(r["token_ids"]) for r in rows} == {d: t.encode(x, add_special_tokens=False).ids for d, x in before.items()}
            assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {d: brute.sha(t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False)) for d, x in before.items()}
        before = after
    with common.tables_made() as made:
        done = corpus_pipeline.run(spark, sf)
    left = [p for p in made if os.path.exists(p.removeprefix("file://"))]
    assert len(made) > 10 and left == [made[-1]]  # each stage's tables go once it is written
    assert sorted(tuple(r) for r in done.select("doc_id", "n_tokens").collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in rows)


def test_copies_are_found_after_their_lines_are_gone(spark, tmp_path):
    """Two documents that share nothing any more once line dedup has been through them."""
    common_lines = "\n".join(f"a line number {i} that both documents share word by word" for i in range(40))
    rows = [(1, common_lines + "\nfirst", "en", "s", 1), (2, common_lines + "\nthe second, with an end of its own that no other has", "en", "s", 1), (3, "something else altogether, long enough to stay", "en", "s", 1), (9, common_lines, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, left, str(tmp_path)).collect()) == [1, 3]


def test_blank_documents_go(spark, sf):
    rows = [(1, "a line that repeats", "en", "s", 1), (2, "\nA line that repeats\n\t", "en", "s", 1), (3, "\n\t\n", "en", "s", 1), (4, "a line that repeats\nkept", "en", "s", 1), (5, None, "en", "s", 0), (6, "a line that repeats\n\u00a0", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, sf).collect()}
    assert got == {1: "a line that repeats", 3: "\n\t\n", 4: "kept", 5: None, 6: "\u00a0"}

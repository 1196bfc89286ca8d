"""The registered queries on the smallest tables, against SQL or brute force."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from mediacat.llm import bpe, neighbours, quality, urls
from mediacat.llm.queries import ORACLES, QUERIES, URL_RULES
from tests.llm import brute
from tests.llm.conftest import SF


def docs_of(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert ours == sorted(map(repr, cursor.fetchall()))


def test_jaccard_join(spark, duck):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_jaccard_join"](spark, SF).collect()}
    assert got == brute.components(docs_of(duck))


def test_quality_rules(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    docs = docs_of(duck)
    assert len(rows) == len(docs)
    for i, text in docs:
        want, r = brute.counts(text), rows[i]
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            assert r[c] == want[c]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rules_on_held_out_labels(spark):
    """Learned on one half of the labels of a larger table, judged on the other."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    other = labels.filter("doc_id % 2 = 1").select("doc_id", "quality")
    rows = quality.judged(docs.select("doc_id", "text"), rules).join(other, "doc_id").filter("NOT __base_failed").collect()
    right = sum(r["__kept"] == (r.quality == 1) for r in rows)
    assert right / len(rows) > 0.97
    assert not [r.doc_id for r in rows if r.quality == 1 and not r["__kept"]]


def test_nearest_neighbours(spark, duck):
    table = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, rows = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = neighbours.dots(rows, rows[q])
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = [got[ids[q]][k + 1] for k in range(20)]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        assert all(s == score[np.searchsorted(ids, v)] for v, s in mine)
        hits += len({v for v, _ in mine} & set(ids[best]))
    assert hits >= 0.95 * 20 * len(got)


def test_byte_bpe(spark, duck):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, SF).collect()}
    for i, text in docs_of(duck):
        ids = plain.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == __import__("hashlib").sha256(packed).hexdigest()
        assert rows[i].decoded_sha256 == brute.sha(text or "")


def test_substring_dedup(spark, duck):
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in QUERIES["op7_substring_dedup"](spark, SF).collect())
    assert got == sorted(brute.substrings(docs_of(duck)))


def test_url_filters(spark, duck):
    rows = {r.page_id: r for r in QUERIES["op10_url_filters"](spark, SF).collect()}
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    assert len(rows) == len(pages)
    for i, url in pages:
        host, path, rule, verdict = plain_rule(url)
        r = rows[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.distrust >= urls.BLOCK_AT and r.distrust > r.trust else "allow"))


def plain_rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = __import__("re").match(r"[^/?#]*", rest)[0].translate(brute.LOWER)
    path = __import__("re").match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def test_pipeline(spark, duck):
    """run() against the plain stages, one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.judged(docs, rules).filter("__kept").select("doc_id").collect()}
    rows = duck.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()
    rows = [r for r in rows if r[0] in kept]
    lines = brute.line_dedup([r[:2] for r in rows])
    rows = [(i, new[3], s) for (i, _, s), new in zip(rows, lines)]
    groups = brute.components([r[:2] for r in rows])
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas()
    duck.register("left_over", frame)
    taken = duck.execute(ORACLES["op9_mixing"].replace("FROM documents", "FROM left_over")).fetchall()
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in rows}
    want = []
    for i, size, _, _, words in taken:
        want += [(i, len(plain.encode_ordinary(texts[i])), brute.sha(texts[i]))] * (words // size if size else 0)
    got = [(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixed_sources", "byte_bpe"]


def test_stages_keep_the_columns(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = out.cache()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()

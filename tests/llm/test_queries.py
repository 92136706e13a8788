"""Every registered query of the subpackage: by its SQL where there is one, on awkward tables, and on empty ones."""

import duckdb
import pytest

import corpus_pipeline
from causeway.llm import queries

SMALL = "/root/testdata/sf0.001"
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, token long, leaks string, __id long, __l string, __q double",
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, doc_id long",
    "pages": "page_id long, url string, html string, text string",
    "conversations": "conv_id long, turn int, role string, text string, n_turns long",
    "embeddings": "vec_id long, embedding array<float>, label int, rank int, score string",
}
COLUMNS = {
    "op1_html_extraction": "page_id url text n_chars",
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op3_quality": "doc_id held_out score predicted",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_decontamination": "doc_id item_id",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_gif_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_jaccard_join": "doc_id n_shingles component_id",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_exact_search": "query_id rank vec_id score",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def _documents():
    good, bad = "The river runs past the old mill and the children play there all day long", "zz qq xx vv zz qq xx"
    texts = [None, "", " \n", "ab cd " * 20_000, "ab cd " * 20_000, good, good, good + " indeed", bad, "日本語 の テキスト", "<|endoftext|> 12 kg"]
    rows = [(k, t, (None, "en", "de")[k % 3], None if k % 4 else "src", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(100 + k, f"{good} number {k} of many words here", "en", "s", 9) for k in range(12)] + [(200 + k, f"{bad} {k}", "de", "s", 9) for k in range(12)]
    rows += [(None, "no id", None, None, None), (5, good, "en", "src", len(good)), (-7, good, "en", "src", 3)]
    return [(*r, 1, "x", 2, "y", 0.5) for r in rows]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("awkward"))
    vectors = [(None if k == 3 else k * 20, (None, [], [None] * 3, [float("nan")] * 3)[k % 4] if k % 9 == 8 else [0.5, -0.25, k % 3 / 4], None if k == 4 else k % 2, 1, "s") for k in range(30)]
    rows = {
        "documents": _documents(),
        "labels": [(k, int(k < 200), 0, "t") for k in range(100, 212)] + [(None, 1, 0, None), (5, None, None, None), (5, 1, 0, "")],
        "benchmark": [(1, "The river runs past the old mill and the children play there all day long", 9), (1, None, 9), (None, "x", 9), (2, "", 9)],
        "pages": [(1, None, "<html><body><article><p>One two three.</p></article></body></html>", "t"), (1, "u", None, None), (None, "u", "", ""), (2, "u", "<div>" * 5000 + "deep", "x")],
        "conversations": [(1, 1, "user", None, 1), (1, 2, "assistant", "x" * 20_000, 1), (None, 1, None, "y", 1), (2, None, "user", "<|im_end|>", 1), (2, None, "user", "<|im_end|>", 1)],
        "embeddings": vectors + vectors[:2],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return at


def test_all_operators_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.SQL) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    expected = con.execute(queries.SQL[name])
    names = [c[0] for c in expected.description]
    got = queries.QUERIES[name](spark, SMALL).select(*names).collect()
    assert len(got) > 0 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_awkward_and_empty_tables(spark, awkward, empty, name):
    rows = queries.QUERIES[name](spark, awkward).collect()
    assert set(COLUMNS[name].split()) <= set(rows[0].asDict())
    n = {"documents": len(_documents()), "pages": 4}
    if name in ("op2_token_files", "op3_quality", "op4_language_id", "op8_gif_media", "op9_token_counts", "op10_jaccard_join", "op13_merkle_manifest"):
        assert len(rows) == n["documents"]
    if name == "op1_html_extraction":
        assert sorted((r.text, r.n_chars) for r in rows)[-1] == ("deep", 4) or len(rows) == n["pages"]
    if name == "op3_quality":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op4_language_id":
        assert {r.lang_pred for r in rows} <= {"en", "de", "und"} and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    if name == "op5_decontamination":
        assert {r.doc_id for r in rows} >= {5, 6, 7, -7} and not {r.doc_id for r in rows} & {0, 1, 3, 8, 9}
    if name == "op7_best_fit_packing":
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            p.sort()
            assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[-1][0] + p[-1][1] <= 2048
    if name == "op10_jaccard_join":
        of = {r.doc_id: r.component_id for r in rows}
        assert of[5] == of[6] == of[7] == of[-7] == -7 and of[0] == 0 and of[3] == of[4] == 3 and of[None] is None
    found = queries.QUERIES[name](spark, empty)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    assert found.count() == (1 if name == "op6_chat_format" else 0)


@pytest.mark.parametrize("name", ["op8_gif_media", "op9_token_counts"])
def test_equal_texts_have_equal_rows(spark, awkward, name):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, awkward).where("doc_id in (0, 1, 3, 4)").collect()}
    same = lambda a, b: {**rows[a].asDict(), "doc_id": 0} == {**rows[b].asDict(), "doc_id": 0}
    assert same(3, 4) and same(0, 1) and not same(1, 3)


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty):
    rows = corpus_pipeline.run(spark, awkward).collect()
    kept = {r.doc_id for r in rows}
    assert not kept & {0, 1, 2, 5, 6, 7, -7} and all(r.length > 0 for r in rows)
    assert corpus_pipeline.run(spark, empty).count() == 0

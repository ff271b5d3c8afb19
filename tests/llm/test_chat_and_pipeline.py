import corpus_pipeline
import duckdb
import pandas as pd

from kithlink.llm import chat, queries
from tests.llm.test_substrings import documents

SCHEMA = "conv_id long, turn int, role string, text string, speaker string"
TURNS = [(1, 0, "system", "Be kind.", "z"), (1, 1, "Ann", "Hi", "z"), (1, 2, "Bo", None, "z"), (1, 3, "Ann", "", "z"), (1, 3, "Ann", "", "z"),
         (2, 0, "system", "alone", "z"), (None, 5, None, "nobody", "z"), (None, None, " ", "later", "z"), (3, 70, "Bo", "far", "z"), (3, 1, "Al", "near", "z")]


def test_every_participant_is_the_assistant_once(spark):
    rows = chat.rotate_perspectives(spark.createDataFrame(TURNS, SCHEMA)).collect()
    seen = {(r.conv_id, r.perspective) for r in rows}
    assert seen == {(1, "Ann"), (1, "Bo"), (None, "unknown"), (3, "Bo"), (3, "Al")}
    for key in seen:
        own = sorted((r for r in rows if (r.conv_id, r.perspective) == key), key=lambda r: r.seq)
        whole = "".join(r.segment for r in own)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        masked = [whole[r.mask_start:r.mask_start + r.mask_length] for r in own if r.mask_length]
        assert all(r.shown_as == "assistant" for r in own if r.mask_length)
        if key == (1, "Ann"):
            assert whole == ("<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=Bo|>\n<|end|>\n"
                             "<|assistant|>\n<|end|>\n<|assistant|>\n<|end|>\n")
            assert masked == ["Hi<|end|>\n", "<|end|>\n", "<|end|>\n"]
        if key == (None, "unknown"):
            assert masked == ["nobody<|end|>\n", "later<|end|>\n"]
    assert chat.rotate_perspectives(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chat_is_what_sql_says(spark):
    got = chat.rotate_perspectives(spark.createDataFrame(TURNS, SCHEMA)).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text", "speaker"]).astype(
        {"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(queries.ORACLE_SQL["op7_chat"]).df()
    text = lambda df: sorted(tuple(str(v).removesuffix(".0").replace("<NA>", "nan").replace("None", "nan") for v in r)
                             for r in df[sorted(want.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_stages_keep_their_columns_and_rules(spark, tmp_path):
    rows = [(i, t, "en" if i % 3 else "fr", "s", len(t or "")) for i, t in documents(9)[:90]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = {r.doc_id for r in now.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(str(tmp_path / f"stage{k}"))
            now = spark.read.parquet(str(tmp_path / f"stage{k}"))
            kept = {r.doc_id: r.text for r in now.collect()}
            assert set(kept) <= set(before) and len(kept) == now.count()
            if name != "line dedup":
                assert all(kept[i] == before[i] for i in kept)
        else:
            whole = {r.doc_id for r in out.collect()}
            assert whole == set(before) <= ids

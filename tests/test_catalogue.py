"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from lexloom.plans import catalogue


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return str(int(v)) if isinstance(v, float) and v == int(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)


def table_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, data, con, name):
    assert table_of(catalogue.queries()[name](spark, data).toPandas()) == table_of(con.execute(catalogue.oracle_sql()[name]).df())


#: How many rows the queries without SQL of their own have.
ROWS = {
    "normal_forms": "select count(*) from (select distinct doc_id, id, source_text from blocks)",
    "bilingual_suppression": "select count(*) from (select distinct doc_id, ord, id, source_text, target_text, source_ref, layout.slide_index, layout.position from blocks)",
    "region_font_sizes": "select count(*) from (select distinct doc_id, image_id, id from regions)",
    "quality_fuzzy": "select count(*) from (select distinct doc_id, image_id, expected_texts, expected_translations, output_texts from validations)",
    "document_json": "select count(*) from doc_meta",
}


def test_every_query_is_held_against_something():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {*ROWS, "paragraphs", "slide_prompts"}


@pytest.mark.parametrize("name", ROWS)
def test_rows(spark, data, con, name):
    assert catalogue.queries()[name](spark, data).count() == con.execute(ROWS[name]).fetchone()[0] > 0


def test_paragraphs_keep_every_line(spark, data, con):
    want = con.execute("select doc_id, image_id, string_agg(coalesce(t, ''), '') from (select distinct doc_id, image_id, bbox, source_text t from regions) group by all").fetchall()
    got = {}
    for r in catalogue.paragraphs(spark, data).collect():
        got[r.doc_id, r.image_id] = got.get((r.doc_id, r.image_id), "") + r.text
    letters = lambda t: sorted(t.replace("\n", ""))
    assert {k: letters(v) for k, v in got.items()} == {(d, i): letters(t) for d, i, t in want}


def test_prompts_hold_every_text_once(spark, data, con):
    import json

    got = [t for r in catalogue.slide_prompts(spark, data).collect() for t in json.loads(r.prompt.rsplit("\n\n", 1)[-1])]
    want = con.execute("select source_text from (select distinct doc_id, ord, id, source_text from blocks where translatable and trim(source_text) != '')").fetchall()
    assert sorted(got) == sorted(t for (t,) in want)

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from marlstone.plans import core
from tests import oracle

WHOLE = ["lexical_batch", "lexical_filtered", "lexical_folder_post", "hybrid_rrf", "tenant_isolation", "context_pack", "context_meta", "context_floor"]


@pytest.fixture(scope="module")
def asked(sf, tmp_path_factory):
    """The tables, with requests of five words that stand in one text of their tenant, the last of them the commonest."""
    at = tmp_path_factory.mktemp("asked")
    for f in os.listdir(sf):
        if f != "search_requests.parquet":
            os.symlink(f"{sf}/{f}", at / f)
    con = oracle.connect(sf)
    rows = con.sql(
        r"""SELECT user_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))[:5] AS w FROM chunks WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) > 5 ORDER BY path LIKE 'Projects/%' DESC, status = 'active' DESC, chunk_id"""
    ).fetchall()
    df = dict(con.sql(r"SELECT w, count(*) FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM chunks) GROUP BY 1").fetchall())
    texts = {}
    for user, words in rows:
        texts.setdefault(user, []).append(" ".join(sorted(words, key=lambda w: (df.get(w, 0), w))))
    requests = pq.read_table(f"{sf}/search_requests.parquet")
    new = [texts[u][i % len(texts[u])] if u in texts else t for i, (u, t) in enumerate(zip(requests["user_id"].to_pylist(), requests["query_text"].to_pylist()))]
    k = requests.schema.get_field_index("query_text")
    pq.write_table(requests.set_column(k, "query_text", pa.array(new, pa.string())), at / "search_requests.parquet")
    return str(at)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_text_matches_its_sql(spark, asked, name):
    oracle.assert_matches(spark, asked, oracle.connect(asked), core.QUERIES[name], core.ORACLE[name])


def test_every_word_of_the_request_counts(spark, asked):
    texts = {r.query_id: set(r.query_text.split()) for r in core.request_rows(spark, asked).collect()}
    rows = {r.row_id: r for r in core.index_rows(spark, asked).select("row_id", "text", "title", "section_path").collect()}
    con = oracle.connect(asked)
    words = lambda t: {w for (w,) in con.execute(r"SELECT unnest(regexp_extract_all(lower(?), '[\p{L}\p{N}]+'))", [t or ""]).fetchall()}
    found = core.QUERIES["lexical_batch"](spark, asked).collect()
    assert found
    assert all(any(texts[r.query_id] <= words(t) for t in (rows[r.row_id].text, rows[r.row_id].title, rows[r.row_id].section_path)) for r in found)
    assert len(found) < core.QUERIES["lexical_last_term"](spark, asked).count()


def test_entry_asks_for_the_whole_text(spark, monkeypatch):
    used = []
    monkeypatch.setattr(core, "request_rows", lambda *a, f=core.request_rows: used.append("whole") or f(*a))
    monkeypatch.setattr(core, "term_requests", lambda *a, f=core.term_requests: used.append("last term") or f(*a))
    assert entry.entry(spark).count() > 0
    assert used == ["whole"]

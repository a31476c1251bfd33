import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.functions.tokens import BpeCounter
from marlstone.functions.vector import Embedders
from marlstone.operators import chunking, context, corpus, index, packing
from marlstone.operators.tenants import Busy, Pool, ReindexJobs, Tenants
from marlstone.sources import pdf, vault
from marlstone.sources.registry import Registry

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# --- PDF ------------------------------------------------------------------------------------------------------------
def document(pages, packed=True, extra=b""):
    """A small file: one font with a map to Unicode for codes 1 to 3, and one without."""
    cmap = b"beginbfchar <01> <0416> <02> <0443> endbfchar beginbfrange <03> <05> <0061> endbfrange"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Count %d /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))),
        3: b"<< /Type /Font /Subtype /Type1 >>",
        4: b"<< /Type /Font /ToUnicode 5 0 R >>",
        5: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap),
        6: b"<< /Title (A \\(small\\) title) /Author <FEFF0416> >>",
    }
    for i, content in enumerate(pages):
        data = zlib.compress(content) if packed else content
        parts[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        parts[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts.items()) + extra + b"trailer << /Root 1 0 R /Info 6 0 R >>\n%%EOF"


PAGES = [b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(wor) 20 (ld) -300 (apart)] TJ ET", b"", b"BT /F2 9 Tf <0102> Tj (\\003\\004) ' T* /F1 9 Tf (\\351t\\351) Tj ET"]


@pytest.mark.parametrize("packed", [True, False])
def test_pages_of_a_pdf(packed):
    assert pdf.extract_pages(document(PAGES, packed)) == ["Hello (you) world apart", "", "Жу ab été"]
    assert pdf.info(document(PAGES)) == {"title": "A (small) title", "author": "Ж"}


def test_objects_in_a_stream():
    inner = b"30 0 31 38 " + b"<< /Type /Catalog /Pages 2 0 R       >>" + b"<< /Any 1 >>"
    data = zlib.compress(inner)
    raw = document(PAGES[:1], extra=b"29 0 obj << /Type /ObjStm /N 2 /First 11 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(data), data))
    assert b"Catalog" in pdf.Document(raw).objects[30][0]


def test_damaged_files(spark):
    whole = document(PAGES)
    df = spark.createDataFrame([(bytearray(x),) for x in (whole, b"%PDF-1.4 junk", b"", whole[:-200], whole.replace(b"/FlateDecode", b"/OddDecode"))] + [(None,)], "raw binary")
    found = [r[0] for r in df.select(chunking.pdf_extractor()("raw")).collect()]
    assert found[0][0] == "Hello (you) world apart" and found[1] == found[2] == found[5] == [] and found[4] == ["", "", ""]
    for n in range(0, len(whole), 37):
        pdf.extract_pages(whole[:n])


# --- tokens ---------------------------------------------------------------------------------------------------------
def test_a_vocabulary_counts_and_caps(spark):
    count = BpeCounter(RANKS)
    texts = ["hello world", "", None, "Straße – 日本語 <|endoftext|>", "line one\nline two is longer\n\nthree"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(count("t")).collect()] == [count.of(t) for t in texts] and count.of("hello world") == 2
    for r in df.select("t", packing.pack_lines("t", 5, count=count).alias("p"), count.cut("t", 3).alias("c")).collect():
        assert r.p is None if r.t is None else "\n".join(r.p) == r.t
        assert r.c is None if r.t is None else r.t.startswith(r.c) and count.of(r.c) <= 3
    assert chunking.markdown_chunks("word " * 300, "n", count.of)
    hits = spark.createDataFrame([(1, 1, 1, 1.0, "a", "t", 0, None, "hello world", None)], "query_id long, rank int, row_id long, score double, path string, title string, chunk_index int, section_path string, text string, type string")
    assert context.assemble(hits, count=count).first().tokens == 2


# --- tenants --------------------------------------------------------------------------------------------------------
def test_a_pool_bounds_tasks_and_their_time(spark):
    running, most, lock = [0], [0], threading.Lock()

    def task(n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.1)
        with lock:
            running[0] -= 1
        return spark.range(n).count()

    pool = Pool(spark, parallel=2, seconds=30)
    assert pool.map([lambda n=n: task(n) for n in range(5)]) == [(n, None) for n in range(5)] and most[0] == 2
    slow = F.udf(lambda x: time.sleep(2) or x, "long")
    found = Pool(spark, 2, 1.5).map([lambda: spark.range(0, 60, 1, 1).select(slow("id").alias("x")).agg(F.sum("x")).first(), lambda: 1 / 0, lambda: 7])
    assert isinstance(found[0][1], TimeoutError) and isinstance(found[1][1], ZeroDivisionError) and found[2] == (7, None)


def state(spark):
    return spark.createDataFrame([("u", "a.md", "h"), ("u", "x/b.md", "h"), ("v", "a.md", "h")], "user_id string, path string, content_hash string")


def test_reindex_jobs(spark):
    jobs, purged = ReindexJobs(), []
    job = jobs.create(state(spark), "u", "folder", "x", lambda rows: rows.filter("content_hash IS NULL").count())
    assert jobs.get(job.id) is job and (job.status, job.files_processed, job.total_files) == ("completed", 1, 1)
    assert jobs.get("none") is None
    full = jobs.create(state(spark), "u", "full", None, lambda rows: rows.count(), purged.append)
    assert purged == ["u"] and full.files_processed == 2
    with pytest.raises(Busy):
        jobs.scan("u", lambda: jobs.create(state(spark), "u", "full", None, lambda rows: 0, purged.append))
    assert jobs.scan("u", lambda: jobs.create(state(spark), "u", "path", "a.md", lambda rows: 1)).status == "completed"
    assert purged == ["u"]
    with pytest.raises(KeyError):
        jobs.create(state(spark), "u", "path", "none.md", lambda rows: 0)
    failed = jobs.create(state(spark), "u", "path", "a.md", lambda rows: 1 / 0)
    assert (failed.status, failed.errors) == ("failed", ["division by zero"])
    assert jobs.rows(spark).filter("status = 'completed'").count() == 3


def test_tenants_come_and_go(spark):
    scanned, ready = [], iter([False, False, True])
    tenants = Tenants(spark, Embedders(), scanned.append)
    assert tenants.added("u", "text-embedding-3-small", "k", lambda: next(ready), pause=0.01) and scanned == ["u"]
    assert not tenants.added("v", "text-embedding-3-small", "k", lambda: False, wait=0.05, pause=0.01) and scanned == ["u"]
    left, rows = tenants.removed("u", state(spark), state(spark).limit(0))
    assert [r.user_id for r in left.collect()] == ["v"] and rows.count() == 0 and "u" not in tenants.pools
    tenants.removed("nobody")


# --- registry, images, errors ---------------------------------------------------------------------------------------
def user(name, **more):
    return {"userId": name, "vaultPath": "/v", "openaiKey": "k", "obsidian": {"email": "a@b.c", "password": "p", "vault": "v"}, **more}


def test_a_changed_registry_rests_before_it_is_read(tmp_path):
    registry = Registry(str(tmp_path / "users.json"))
    registry.load()
    registry.add(user("ann"))
    assert registry.get("ann")["vaultPath"] == "/v" and registry.get("bob") is None
    other, now = Registry(str(tmp_path / "users.json")), [0.0]
    other.load()
    tick = registry.watch(clock=lambda: now[0])
    assert tick() is None
    other.add(user("bob"))
    assert tick() is None
    now[0] = 0.3
    assert tick() is None
    now[0] = 0.6
    assert tick() == {"added": ["bob"], "removed": [], "updated": []}
    now[0] = 2.0
    assert tick() is None


def test_an_ingest_links_images_to_notes(spark):
    docs = spark.createDataFrame([("u", "n.md", "see ![[p.png]] and ![[x/q.jpg|w]]"), ("u", "m.md", "![[p.png]]"), ("v", "n.md", "![[r.png]]")], "user_id string, path string, content string")
    files = spark.createDataFrame([("u", "n.md", "1"), ("u", "m.md", "2"), ("u", "img/p.png", "3"), ("u", "q.jpg", "4"), ("u", "r.png", "5"), ("u", "old.png", "6")], "user_id string, path string, content_hash string")
    before = spark.createDataFrame([("u", "old.png", "6", '["kept.md"]')], "user_id string, path string, content_hash string, linked_notes string")
    none = spark.createDataFrame([], index.SCHEMA)
    _, rows, after = corpus.ingest(docs, before, none, lambda t: F.array(F.lit(1.0).cast("float")), files)
    links = {r.path: r.linked_notes for r in after.collect()}
    assert links == {"n.md": None, "m.md": None, "img/p.png": '["m.md","n.md"]', "q.jpg": '["n.md"]', "r.png": "[]", "old.png": '["kept.md"]'}
    assert {r.path for r in rows.collect()} == {"n.md", "m.md"}


def test_errors_have_codes():
    assert vault.error_of(vault.AlreadyExists("x")) == (409, "x") and vault.error_of(vault.NotFound("y"))[0] == 404 and vault.error_of(vault.UnsafePath("z"))[0] == 400
    assert vault.error_of(RuntimeError("secret")) == (500, "internal error")

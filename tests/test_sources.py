import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone.sources import registry, vault


@pytest.fixture
def root(tmp_path):
    for p, text in {"a.md": "---\ntags: x\nn: 1\n---\nBody\n", "Заметки/б.md": "текст", "sub/deep/c.PDF": "pdf", "_under.md": "u", ".hidden/x.md": "h", "sub/.dot.md": "d", "data.bin": "b"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text, "utf-8")
    os.symlink("/etc/hostname", tmp_path / "link.md")
    return str(tmp_path)


def test_listing(spark, root):
    rows = vault.listing(spark, {"u": root}).collect()
    assert [r.path for r in rows if r.type == "file"] == ["_under.md", "a.md", "data.bin", "sub/deep/c.PDF", "Заметки/б.md"]
    assert {r.path for r in rows if r.type == "directory"} == {"sub", "sub/deep", "Заметки"}
    assert [r.path for r in vault.listing(spark, {"u": root}, ext="PDF").collect()] == ["sub/deep/c.PDF"]
    assert vault.listing(spark, {"u": root}, ext="pdf").count() == 0
    assert {x[0] for x in vault.walk(root, recursive=False)} == {"_under.md", "a.md", "data.bin", "sub", "Заметки"}


def test_snapshot_and_binary_source_agree(spark, root):
    mine = {r.path: r.content_hash for r in vault.snapshot(spark, {"u": root}).collect()}
    assert mine.keys() == {"_under.md", "a.md", "sub/deep/c.PDF", "Заметки/б.md"}
    theirs = {r.path: r.content_hash for r in vault.read_binary(spark, root).collect()}
    assert all(theirs[p] == h for p, h in mine.items() if p in theirs) and "a.md" in theirs


@pytest.mark.parametrize("bad", ["", "/etc/passwd", "../x", "a/../../x", ".hidden/x.md", "sub/.dot.md", "link.md", "./a.md"])
def test_unsafe_paths(root, bad):
    with pytest.raises(vault.UnsafePath):
        vault.safe_path(root, bad)


def test_files(root):
    assert vault.read_content(root, "a.md") == "Body"
    assert vault.read_metadata(root, "a.md") == ({"tags": ["x"], "n": 1}, None)
    with pytest.raises(vault.NotText):
        vault.read_content(root, "data.bin")
    with pytest.raises(vault.NotFound):
        vault.read_content(root, "none.md")
    vault.create_note(root, "new/n.md", "hi", {"a": 1})
    with pytest.raises(vault.AlreadyExists):
        vault.create_note(root, "new/n.md", "again")
    vault.add_content(root, "new/n.md", "end")
    vault.add_content(root, "new/n.md", "start", "prepend")
    assert vault.read_content(root, "new/n.md") == "start\n\nhi\n\nend" and vault.read_metadata(root, "new/n.md")[0] == {"a": 1}
    assert vault.update_metadata(root, "new/n.md", {"a": None, "b": [1]}) == {"b": [1]}
    vault.replace_content(root, "new/n.md", "plain")
    assert vault.read_metadata(root, "new/n.md")[0] == {} and open(f"{root}/new/n.md").read() == "plain\n"
    vault.move_note(root, "new/n.md", "other/m.md")
    with pytest.raises(vault.AlreadyExists):
        vault.move_note(root, "a.md", "other/m.md")
    vault.delete_note(root, "other/m.md")
    assert not os.path.exists(f"{root}/other/m.md") and not [f for f in os.listdir(f"{root}/new") if f.startswith(".draft")]


def test_frontmatter_columns(spark):
    df = spark.createDataFrame([("---\ntags: [a, b]\nx: {y: 1}\n---\n\nbody \n",), ("no block",), ("---\nbad: [\n---\nrest",), (None,), ("---\n---\nempty",)], "raw string")
    out = df.select(vault.body_of("raw").alias("b"), vault.metadata_of(F.col("raw")).alias("m")).collect()
    assert [r.b for r in out] == ["body", "no block", "rest", None, "empty"]
    assert out[0].m.metadata == {"tags": '["a", "b"]', "x": '{"y": 1}'} and out[0].m.warning is None
    assert out[2].m.metadata == {} and out[2].m.warning


def user(name, **more):
    return {"userId": name, "apiKey": f"cv-{name}", "vaultPath": "/v", "openaiKey": "k", "obsidian": {"email": "a@b.co", "password": "p", "vault": "v"}, **more}


def test_registry_file(tmp_path):
    r = registry.Registry(str(tmp_path / "users.json"))
    assert r.load() == []
    r.add(user("a"))
    with pytest.raises(registry.InvalidRegistry):
        r.add(user("a", apiKey="cv-other"))
    with pytest.raises(registry.InvalidRegistry):
        r.add(user("b", apiKey="cv-a"))
    with pytest.raises(registry.InvalidRegistry):
        r.add(user("Bad Id"))
    assert r.reload() is None
    (tmp_path / "users.json").write_text(json.dumps([user("a", vaultPath="/w"), user("c")]))
    assert r.reload() == {"added": ["c"], "removed": [], "updated": ["a"]}
    (tmp_path / "users.json").write_text("{broken")
    assert r.reload() is None and len(r.users) == 2
    with pytest.raises(KeyError):
        r.remove("zz")


def test_registry_frames(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps([user("a"), user("b", apiKey="nope"), user("c", apiKey="cv-a")]))
    df = registry.scan(spark, str(tmp_path / "u.json"))
    assert {(r.userId, r.problem) for r in registry.violations(df).collect()} == {("b", "apiKey"), ("c", "duplicate apiKey")}
    assert registry.public(df).columns == ["userId", "vaultPath", "status"]
    assert "apiKey" not in registry.by_key(df, "cv-a").columns
    old, new = df.filter("userId <> 'c'"), df.filter("userId <> 'a'").withColumn("vaultPath", F.lit("/w"))
    assert {(r.userId, r.change) for r in registry.diff(old, new).collect()} == {("a", "removed"), ("b", "updated"), ("c", "added")}

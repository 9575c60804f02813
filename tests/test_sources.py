import os
import tempfile

from pyspark.sql import functions as F

from auditspark.operators import scan as S
from auditspark.sources import files as FS
from auditspark.sources import reports as RS


def test_binary_file_tree(spark):
    root = tempfile.mkdtemp(prefix="auditspark-tree-")
    layout = {
        "src/app.js": b'const password = "hunter2hunter2";\n',
        "node_modules/x/index.js": b'const password = "hunter2hunter2";\n',
        "deploy/nginx.conf": b"DB=postgresql://u:p@h/db\n",
        "img/logo.bin.js": b"\x00\x01\x02binary",
        "empty.py": b"",
        "dist/app.min.js": b"x",
        ".env": b"API_URL=https://db_1.example.com\n",
        "site/.htaccess": b"Options All\n",
        ".github/workflows/ci.yml": b"on: push\n",
    }
    for rel, data in layout.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    tree = FS.read_binary_tree(spark, root, "repo")
    inv = {(r.path, r.category) for r in FS.file_inventory(tree).collect()}
    sizes = {r.path: r.length for r in tree.collect()}
    assert sizes["empty.py"] == 0 and sizes[".env"] > 0 and "site/.htaccess" in sizes and ".github/workflows/ci.yml" in sizes
    assert "node_modules/x/index.js" in {r.path for r in FS.read_binary_tree(spark, root, "repo", excluded=True).collect()}
    assert ("src/app.js", "source") in inv and ("deploy/nginx.conf", "config") in inv
    assert not any(p.startswith(("node_modules/", "dist/")) for p, _ in inv)
    text = FS.read_text(tree.where(~FS.is_excluded("path")))
    flags = {r.path: r.is_binary for r in text.collect()}
    assert flags["img/logo.bin.js"] is True and flags["src/app.js"] is False
    found = {(r.file, r.rule_id) for r in S.detect(spark, S.prepare_lines(text.drop("length"))).collect()}
    assert ("src/app.js", "GENERIC_PASSWORD") in found
    assert ("deploy/nginx.conf", "DATABASE_CONNECTION_STRING") in found
    assert not any(f.startswith("img/") or f == "empty.py" for f, _ in found)


def test_unreadable_file_is_binary(spark):
    df = spark.createDataFrame([("r", "a.js", None), ("r", "b.js", bytearray(b"x" * 9000 + b"\0"))], "repo_id string, path string, content binary")
    assert all(r.is_binary for r in FS.read_text(df).collect())
    assert not FS.read_text(df, sniff=FS.REFERENCE_SNIFF).where("path = 'b.js'").first().is_binary


def test_distinct_content_keeps_unknown_languages(spark):
    from auditspark.rules.catalogue import builtin_rules
    line = 'password = "hunter2hunter2"\n'
    df = spark.createDataFrame([("r", "Dockerfile", line), ("r", ".htaccess", line), ("r", "src/a.js", line)],
                               "repo_id string, path string, content string")
    want = {(r.file, r.rule_id) for r in S.detect(spark, S.prepare_lines(df)).collect()}
    got = {(r.file, r.rule_id) for r in S.detect_distinct_content(spark, df, builtin_rules()).collect()}
    assert got == want and {f for f, _ in want} >= {"Dockerfile", "src/a.js"}


def test_manifest_deps_last_section_wins(spark):
    doc = '{"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": "3"}}'
    comp = '{"require": {"laravel/framework": "^10"}, "require-dev": {"x/y": "1"}}'
    df = spark.createDataFrame([("r", "package.json", doc), ("r", "sub/composer.json", comp),
                                ("r", "README.md", "text")], "repo_id string, path string, content string")
    got = {(r.ecosystem, r.name, r.version) for r in RS.manifest_deps(df).collect()}
    assert got == {("npm", "a", "1"), ("npm", "b", "2"), ("npm", "c", "3"), ("composer", "laravel/framework", "^10"),
                   ("composer", "x/y", "1")}


def test_checksums(spark):
    h = "A" * 64
    df = spark.createDataFrame([(f"{h}  *dist/tool.tar.gz",), ("garbage",)], "text string")
    r = RS.parse_checksums(df).collect()
    assert [(x.digest, x.name) for x in r] == [("a" * 64, "tool.tar.gz")]


def test_a_deep_tree_under_one_folder(spark, tmp_path):
    """Listed by many tasks; what can't be read is a row, links that lead back are named."""
    import os
    for k in range(40):
        d = tmp_path / "src" / f"d{k % 8}" / f"e{k}" / "f"
        d.mkdir(parents=True)
        (d / "a.js").write_text("x")
    os.symlink(tmp_path / "src", tmp_path / "src" / "d0" / "loop")
    found = FS.list_tree(spark, str(tmp_path))
    rows = {r.path: r for r in found.collect()}
    assert sum(p.endswith("/a.js") for p in rows) == 40 and rows["src"].is_dir and rows["src/d0/loop"].error == "link to a folder"
    assert found.where("path like '%/a.js'").select(F.spark_partition_id()).distinct().count() > 2
    gone = spark.createDataFrame([("no such folder",)], "path string").mapInArrow(FS._list_folders(str(tmp_path)), FS._LISTED).first()
    assert gone.path == "no such folder" and gone.is_dir and gone.error
    tree = FS.read_text(FS.read_binary_tree(spark, str(tmp_path)))
    assert tree.where("is_binary").count() == 1 and tree.where("content = 'x'").count() == 40


def test_bytes_to_text(spark):
    rows = [("ok", "é\n".encode()), ("nul", b"a\0b"), ("bad", b"\xc3(\xff\xe2\x82x"), ("cut", b"ab\xe2\x82"), ("none", None), ("empty", b"")]
    df = spark.createDataFrame([("r", p, None if c is None else bytearray(c)) for p, c in rows], "repo_id string, path string, content binary")
    got = {r.path: (r.is_binary, r.content) for r in FS.read_text(df).collect()}
    assert got == {"ok": (False, "é\n"), "nul": (True, None), "bad": (False, "�(��x"), "cut": (False, "ab�"), "none": (True, None), "empty": (False, "")}

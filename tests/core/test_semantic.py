"""Facts of two versions on hand-written files."""

import hashlib

import pytest

from tracewright.operators import semantic

SCHEMA = "project long, ref string, path string, content string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def versions(spark):
    rows = [
        (1, "a", "src/x.php", "Route::get('/old', f);\nRoute::get('/same', f);"),
        (1, "b", "src/x.php", "Route::get('/same', f);\nRoute::get('/new', f);\nx(); Route::GET( \"/New\", g);"),
        (1, "a", "old/auth.ts", "process.env.TOKEN; process.env.OTHER"),
        (1, "b", "new/auth.ts", "process.env.TOKEN; process.env.OTHER"),
        (1, "a", "keep.sql", "DROP TABLE kept"),
        (1, "b", "keep.sql", "DROP TABLE kept"),
        (1, "b", "key.txt", "k = sk-abcdefghijklmnopqrstuvwxyz"),
        (1, "b", "gone.txt", None),
        (1, "b", "empty.css", ""),
        (2, "b", "package.json", '{"dependencies": {"A": "1"}, "devDependencies": {"a": "1", "n": 2}}'),
        (2, "a", "composer.json", "{broken"),
        (2, "b", "pages/api/[...slug]/index.ts", "export async function PATCH() {}"),
        (2, "c", "other.sql", "DROP TABLE other"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_delta(versions):
    got = {(r.project, r.kind, r.change, r.name, r.value): (r.identity, r.path, r.line) for r in semantic.delta(versions, "a", "b").collect()}
    assert got == {
        (1, "routes", "removed", "GET", "/old"): (sha("route|get /old"), "src/x.php", 1),
        (1, "routes", "added", "GET", "/New"): (sha("route|get /new"), "src/x.php", 3),
        (1, "security", "added", semantic.SECRET, "<redacted>"): (sha("security|secret-shaped value|k = sk-abcdefghijklmnopqrstuvwxyz"), "key.txt", 1),
        (1, "architecture", "added", "User interface", "empty.css"): (sha("architecture|user interface"), "empty.css", 1),
        (2, "dependencies", "added", "a", "1"): (sha("dependency|a@1"), "package.json", 1),
        (2, "dependencies", "added", "n", "2"): (sha("dependency|n@2"), "package.json", 1),
        (2, "routes", "added", "PATCH", "/api/{slug}"): (sha("route|patch /api/{slug}"), "pages/api/[...slug]/index.ts", 1),
        (2, "architecture", "added", "API and server behavior", "pages/api/[...slug]/index.ts"): (sha("architecture|api and server behavior"), "pages/api/[...slug]/index.ts", 1),
    }


def test_cap_takes_the_first_stated(versions):
    rows = semantic.delta(versions, "a", "b", most=1).filter("project = 2 and kind = 'dependencies'").collect()
    assert [r.name for r in rows] == ["a"]


def test_changed_kinds(versions, spark):
    got = {(r.project, r.kind): (r.added, r.removed, r.may_break) for r in semantic.changed_kinds(semantic.delta(versions, "a", "b")).collect()}
    assert got[(1, "routes")] == (1, 1, True) and got[(1, "architecture")] == (1, 0, False) and (1, "environment") not in got
    assert semantic.delta(spark.createDataFrame([], SCHEMA), "a", "b").count() == 0
    assert semantic.delta(versions, "a", "a").count() == 0

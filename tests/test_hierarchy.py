import random

import pytest

from gleaner.operators.hierarchy import chains, descendants, loops, paths, resolve

SCHEMA = "id string, parent_id string, replies array<string>, root_id string, nid long"


def brute(rows):
    ids = {r[0] for r in rows if r[0] is not None}
    own, listed = {}, {}
    for i, p, rep in rows:
        if i is None:
            continue
        p = "".join((p or "").split()).split("#comment-")[-1]
        if p not in ("", "0"):
            own.setdefault(i, set()).add(p)
        for c in rep or []:
            listed.setdefault(c, set()).add(i)
    par = {}
    for i in ids:
        got = [p for p in own.get(i, ()) if p in ids]
        par[i] = min(got) if got else None if i in own else min(listed[i]) if i in listed else None

    def walk(i):
        seen = []
        while par[i] is not None and i not in seen:
            seen.append(i)
            i = par[i]
        return (min(seen[seen.index(i) :]), -1) if i in seen else (i, len(seen))

    return {i: walk(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, "clash", 7) for a, b, c in rows], SCHEMA)


CASES = {
    "empty": [],
    "null id": [(None, "1", None), ("1", None, None)],
    "anchors and blanks": [("1", " ", None), ("2", "#comment-1", None), ("3", " 2 ", ["4"]), ("4", "0", None), ("5", "99", None)],
    "self answer and below": [("1", "1", None), ("2", "1", None), ("3", "2", None)],
    "loop of three": [("b", "a", None), ("c", "b", None), ("a", "c", None), ("d", "a", None)],
    "repeats and ties": [("1", None, ["3"]), ("1", None, None), ("2", None, ["3"]), ("3", None, None), ("3", None, None)],
    "parent beats listing": [("1", None, ["3"]), ("2", None, None), ("3", "2", None)],
    "differing references": [("1", None, None), ("2", None, None), ("3", "2", None), ("3", "1", None), ("3", "77", None)],
    "chain": [(str(k), str(k - 1) if k > 1 else None, None) for k in range(1, 71)],
    "chain just past a jump, beside a loop": [(str(k), str(k - 1) if k > 1 else None, None) for k in range(1, 36)] + [("x", "y", None), ("y", "x", None)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    got = {r["id"]: (r["root_id"], r["node_depth"]) for r in resolve(frame(spark, CASES[name]), replies_col="replies").collect()}
    assert got == brute(CASES[name])


def test_random_against_brute(spark):
    rng = random.Random(4)
    rows = [(str(k), rng.choice([None, "", "0", f"#comment-{rng.randrange(90)}", str(rng.randrange(90))]), rng.sample([str(x) for x in range(80)], rng.randrange(3)) or None) for k in range(80)]
    assert {r["id"]: (r["root_id"], r["node_depth"]) for r in resolve(frame(spark, rows), replies_col="replies").collect()} == brute(rows)


def test_paths_and_descendants(spark):
    p = paths(frame(spark, CASES["anchors and blanks"]), replies_col="replies")
    got = {r["id"]: r["path"] for r in p.collect()}
    assert got == {"1": "1", "2": "1/2", "3": "1/2/3", "4": "1/2/3/4", "5": "5"}
    assert {tuple(r) for r in descendants(chains(frame(spark, CASES["anchors and blanks"]), replies_col="replies")).collect()} == {("1", "2", 1), ("1", "3", 2), ("1", "4", 3), ("2", "3", 1), ("2", "4", 2), ("3", "4", 1)}


def test_hot_parent(spark):
    rows = [("1000", None, None)] + [(str(k), "1000", None) for k in range(1, 400)]
    assert {r["node_depth"] for r in resolve(frame(spark, rows)).where("id <> '1000'").collect()} == {1}


def test_ids_with_slashes_and_loops(spark):
    rows = [("a/b", None, None), ("c/d", "a/b", None), ("e", "c/d", None), ("x", "y", None), ("y", "x", None), ("z", "x", None)]
    got = chains(frame(spark, rows), replies_col="replies")
    assert {tuple(r) for r in descendants(got).collect()} == {("a/b", "c/d", 1), ("a/b", "e", 2), ("c/d", "e", 1)}
    assert {tuple(r) for r in loops(got).collect()} == {("x", "x"), ("x", "y"), ("x", "z")}

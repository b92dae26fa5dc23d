"""The proximity of all cases, against all pairs of cases."""

from collections import Counter, defaultdict

from timberline import catalogue

SF = "/root/testdata/sf0.001"


def test_proximity_groups_cover_all_cases(spark):
    q = catalogue.queries()
    leaves = defaultdict(set)
    for r in q["apply_tree"](spark, SF).select("tree", "case_id", "path").collect():
        leaves[r["case_id"]].add((r["tree"], r["path"]))
    member = {r["case_id"]: r["leaves"] for r in q["proximity_members"](spark, SF).collect()}
    assert set(member) == set(leaves) and max(member) > 100
    rows = q["proximity_groups"](spark, SF).collect()
    n = {(r["leaves_a"], r["leaves_b"]): r["n"] for r in rows}
    assert len(n) == len(rows)
    for a in leaves:
        for b in leaves:
            assert n.get((member[a], member[b]), 0) == len(leaves[a] & leaves[b])
    cases = Counter(member.values())
    assert all((r["cases_a"], r["cases_b"]) == (cases[r["leaves_a"]], cases[r["leaves_b"]]) for r in rows)

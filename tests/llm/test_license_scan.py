import pytest
from compare import compare, duck

from caseload.llm import license_scan, queries


def brute(text, threshold=license_scan.THRESHOLD):
    """Every different unit against every template, without bounds."""
    import re

    low = (text or "").translate(str.maketrans(license_scan.UPPER_AZ, license_scan.LOWER_AZ))
    low = re.sub(r"[^a-z0-9\n]+", " ", low)
    units = {" ".join(u.split()) for u in [low, *re.split(r"\n *\n[ \n]*", low), *low.split("\n")]}
    found = []
    for u in units:
        a = license_scan.bigrams(u)
        for name, texts in license_scan.TEMPLATES.items():
            for t in texts:
                b = license_scan.bigrams(t)
                dice = 2.0 * len(a & b) / (len(a) + len(b))
                if dice >= threshold:
                    found.append((-dice, name))
    best = min(found, default=(None, None))
    return best[1], None if best[0] is None else -best[0], ",".join(sorted({n for _, n in found})), len(found)


def test_same_as_sql(spark):
    name, sf = "op1_license_scan", "/root/testdata/sf0.01"
    error, rows, _ = compare(spark, duck(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert error is None and rows == 1000


def test_same_as_brute_force(spark, edge, docs):
    mit = license_scan.TEMPLATES["MIT"][1]
    own = spark.createDataFrame([
        (1, f"intro line\n\n{mit.replace(' to ', chr(10) + 'to ')}\n\nlast line", None, None, 0),
        (2, f"# {mit.upper()}", None, None, 0), (3, "Some code.\nAll  rights -- reserved!\nAll rights reserved", None, None, 0),
        (4, "Licensed under CC BY 4.0.\nLicensed under CC BY-NC 4.0.", None, None, 0), (5, "All rights reserved " * 50, None, None, 0)], edge.schema)
    for df in (edge, own, docs):
        got = sorted(map(str, (tuple(r) for r in license_scan.scan(df).collect())))
        assert got == sorted(str((r["doc_id"], *brute(r["text"]))) for r in df.collect())
    by_id = {r["doc_id"]: r for r in license_scan.scan(own).collect()}
    assert by_id[1]["license"] == "MIT" and by_id[2]["dice"] == 1.0 and by_id[3]["n_matches"] == 1
    assert by_id[4]["license"] == "CC-BY-4.0" and "CC-BY-NC-4.0" in by_id[4]["licenses"]


def test_general_interface(clashing, nothing):
    assert license_scan.scan(nothing).count() == 0
    assert license_scan.scan(clashing).count() == clashing.count()
    assert license_scan.scan(clashing, {}).where("license is not null or n_matches > 0").count() == 0
    assert license_scan.scan(clashing, {"one": ["word"]}).where("n_matches > 0").count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(clashing, {"big": [" ".join(map(str, range(license_scan.MAX_TEMPLATE_WORDS + 2)))]})


def test_plan_is_one_scan(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Exchange", "Python", "Join") if w in plan]

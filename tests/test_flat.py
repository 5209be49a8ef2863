"""The delimited source on small documents."""

from signalcontext.sources import flat


def _claims(spark, *texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    return sorted((r.file, r.line, r.column, r.kind, r.value, r.outcome) for r in flat.claims(docs).fillna("").collect())


def test_headers_state_kinds(spark):
    got = _claims(spark, "\ufeffDomain,IP,notes\r\nA.example.org,192.0.2.1,=x\r\n\r\n# c\r\nnot one,192.0.2.2,y\r\n")
    assert got == [
        ("0", 1, 0, "domain_name", "a.example.org", "claim"), ("0", 1, 1, "ipv4_address", "192.0.2.1", "claim"),
        ("0", 4, 0, "", "", "unmappable_field"), ("0", 4, 1, "ipv4_address", "192.0.2.2", "claim"),
    ]


def test_bare_lines_and_delimiters(spark):
    got = _claims(spark, "# list\nexample.org\n\n198.51.100.7/24\nwords here", "x\t192.0.2.9\ny, z\t192.0.2.8", "", None)
    assert got == [
        ("0", 1, 0, "domain_name", "example.org", "claim"), ("0", 3, 0, "ip_range", "198.51.100.0/24", "claim"),
        ("1", 0, 1, "ipv4_address", "192.0.2.9", "claim"), ("1", 1, 1, "ipv4_address", "192.0.2.8", "claim"),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url;host\nhttp://Example.org;example.org\n")
    rows = flat.claims(flat.documents(spark, str(tmp_path))).collect()
    assert sorted((r.kind, r.value) for r in rows) == [("domain_name", "example.org"), ("url", "http://example.org/")]

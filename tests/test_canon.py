"""Canonical forms, transforms and escapes, case by case."""

import pytest
from pyspark.sql import functions as F

from signalcontext.functions import canon as c

CASES = [
    (c.ip_address, "2001:0DB8:0:0:0:0:0:1", "2001:db8::1"), (c.ip_address, "::", "::"), (c.ip_address, "::1", "::1"), (c.ip_address, "1:0:0:2:0:0:0:3", "1:0:0:2::3"),
    (c.ip_address, "2001:db8:0:1:1:1:1:1", "2001:db8:0:1:1:1:1:1"), (c.ip_address, "::ffff:192.0.2.1", None), (c.ip_address, "::192.0.2.1", None), (c.ip_address, "64:ff9b::192.0.2.33", "64:ff9b::c000:221"),
    (c.ip_address, "1::2::3", None), (c.ip_address, "12345::", None), (c.ip_address, "1:2:3:4:5:6:7", None), (c.ip_address, "192.0.2.1", "192.0.2.1"), (c.ip_address, "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:0"),
    (c.any_range, "2001:db8:ffff::/33", "2001:db8:8000::/33"), (c.any_range, "2001:db8::/129", None), (c.any_range, "192.0.2.77/24", "192.0.2.0/24"),
    (c.any_network, "192.0.2.9/8", "192.0.0.0/8"), (c.any_network, "HTTP://Example.org", "http://example.org/"), (c.any_network, "A@Example.org", "A@example.org"), (c.any_network, "Example.org", "example.org"),
    (c.file_name, " a.exe ", "a.exe"), (c.file_name, "a/b", None), (c.file_name, "", None), (c.file_path, "c:/Users/x", "windows:C:\\Users\\x"), (c.file_path, "/etc/passwd", "posix:/etc/passwd"), (c.file_path, "\\\\srv\\x", "windows:\\\\srv\\x"),
    (c.cpe, "CPE:2.3:A:v:p:1:*:*:*:*:*:*:*", "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*"), (c.cpe, "cpe:/a:v:p", None), (c.package_url, "PKG://NPM/%40a/B@1", "pkg:npm/%40a/B@1"), (c.package_url, "pkg:npm", None),
    (c.container_image, "Reg.io:5000/App:V1@sha256:AB", "reg.io:5000/app:V1@sha256:AB"), (c.container_image, "app:", None), (c.container_image, "Reg.io:5000/App", "reg.io:5000/app"), (c.container_image, "app@", None),
    (c.cloud_resource, "ARN:AWS:S3:US:123:Bucket/Key:x", "arn:aws:s3:us:123:Bucket/Key:x"), (c.cloud_resource, "arn:aws:s3", None), (c.cloud_resource, "/Subscriptions/AB/ResourceGroups/x", "/subscriptions/AB/resourcegroups/x"), (c.cloud_resource, "projects/P/x", "projects/P/x"), (c.cloud_resource, "plain", None),
    (c.kubernetes_resource, "Pod/ns/Name", "pod/ns/Name"), (c.kubernetes_resource, "Pod/n", "pod/n"), (c.kubernetes_resource, "a//b", None), (c.kubernetes_resource, "a", None),
    (c.undefang, "hXXps://a[.]b[dot]c(at)d[://]e[//]f{.}g", "https://a.b.c@d://e//f.g"), (c.undefang, "a{dot}b", "a{dot}b"), (c.preview, "a\x00b" + "c" * 99, "ab" + "c" * 62),
    (c.pattern_escaped, "a'b\\c", "a\\'b\\\\c"), (c.markdown_escaped, "a*b\n_c", "a\\*b \\_c"), (c.cve, "cve-2024-12345", "CVE-2024-12345"), (c.cve, "cve-24-1", None), (c.mac, "00-1A-2B-3C-4D-5E", "00:1a:2b:3c:4d:5e"),
]
CHAINS = [
    ("  A b ", [{"op": "trim"}, {"op": "lowercase"}], "a b"), ("É", [{"op": "lowercase"}], "É"), ("xyz", [{"op": "strip_prefix", "prefix": "x"}, {"op": "strip_suffix", "suffix": "z"}], "y"),
    ("a,b,c", [{"op": "split_take", "separator": ",", "index": 1}], "b"), ("a,b", [{"op": "split_take", "separator": ",", "index": 5}], "a,b"), ("a.b", [{"op": "replace", "from": ".", "to": "-"}], "a-b"),
    ("aéb", [{"op": "substring", "start": 0, "length": 2}], "a"), ("aéb", [{"op": "substring", "start": 2, "length": 2}], "b"), ("a \t b", [{"op": "collapse_whitespace"}, {"op": "uppercase"}], "A B"), ("hxxp://a[.]b", [{"op": "undefang"}], "http://a.b"),
]


def test_cases(spark):
    row = spark.range(1).select(*(f(F.lit(raw)).alias(f"v{i}") for i, (f, raw, _) in enumerate(CASES))).first()
    assert [(f.__name__, raw, row[i]) for i, (f, raw, _) in enumerate(CASES)] == [(f.__name__, raw, want) for f, raw, want in CASES]


def test_transforms(spark):
    row = spark.range(1).select(*(c.transformed(F.lit(raw), chain).alias(f"v{i}") for i, (raw, chain, _) in enumerate(CHAINS))).first()
    assert list(row) == [want for *_, want in CHAINS]
    assert spark.range(1).select(F.octet_length(c.transformed(F.lit("é" * 9000), [{"op": "trim"}])).alias("n")).first().n == 8192
    with pytest.raises(ValueError):
        c.transformed(F.lit("a"), [{"op": "rot13"}])


def test_times_and_depth(spark):
    t = F.lit
    row = spark.range(1).select(c.rfc3339(t("2024-01-02t03:04:05z")).cast("string").alias("a"), c.rfc3339(t("2024-01-02T03:04:05+02:00")).cast("string").alias("b"), c.rfc3339(t("2024-01-02T03:04:05")).alias("c"), c.rfc3339(t("2024-13-02T03:04:05Z")).alias("d"),
                                c.has_non_utc_offset(t("2024-01-02T03:04:05+02:00")).alias("e"), c.has_non_utc_offset(t("2024-01-02T03:04:05Z")).alias("f"), c.json_depth(t('{"a": [{"b": "}]{["}, []]}')).alias("g"), c.json_depth(t("1")).alias("h")).first()
    assert tuple(row) == ("2024-01-02 03:04:05", "2024-01-02 01:04:05", None, None, True, False, 3, 0)

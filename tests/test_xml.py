"""The element reader's limits, and the frames of indicators and incidents."""

import pytest

from signalcontext.sources import xml

IOC = """<?xml version="1.0" encoding="utf-16"?>
<x:ioc xmlns:x="urn:a" id="k1"><!-- no --><short_description> A &amp; B </short_description><description/>
<authored_by>who</authored_by><last-modified>2024</last-modified>
<definition><Indicator operator="OR">
 <IndicatorItem condition="is"><Context document="d" search="Network/DNS"/><Content type="string"> Evil.Example </Content></IndicatorItem>
 <IndicatorItem><Context search="FileItem/Md5sum"/><Content><![CDATA[%s]]></Content></IndicatorItem>
 <IndicatorItem condition="contains"><Context search="Network/URI"/><Content>evil</Content></IndicatorItem>
 <IndicatorItem condition="IS"><Context search="Registry/Path"/><Content>x</Content></IndicatorItem>
 <IndicatorItem condition="is"><Context search="Network/IP"/><Content>999</Content></IndicatorItem>
 <IndicatorItem condition="is"><Content>x</Content></IndicatorItem><IndicatorItem><Context search="Network/IP"/><Content/></IndicatorItem>
 <Indicator><IndicatorItem condition="is"><Context search="Network/DNS"/><Content>evil.example</Content></IndicatorItem></Indicator>
</Indicator></definition></x:ioc>""" % ("A" * 32)

IODEF = """<IODEF-Document><Incident purpose="mitigation"><IncidentID name="CSIRT.example">17</IncidentID><ReportTime>t1</ReportTime><Description>d</Description>
<Assessment><Impact severity="high"/><Impact severity="low"/></Assessment>
<EventData><Node><Address category="ipv4-addr">192.0.2.1</Address><Address category="e-mail">a@B.example</Address><Address category="asn">5</Address><Address category="ipv4-net">192.0.2.0/24</Address><Address category="url"> </Address><Address category="ipv6-addr">zz</Address></Node></EventData></Incident>
<Incident><ReportTime>t2</ReportTime></Incident><Incident><IncidentID/></Incident><Incident><IncidentID>9</IncidentID></Incident></IODEF-Document>"""


def frame(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(texts)], "doc string, text string, n int")


def test_openioc(spark):
    got = xml.openioc(frame(spark, IOC, None, " ", "<ioc/>", "<a/>", "<ioc id='q'/>", "<ioc id='w'><definition><IndicatorItem><Context search='x'/><Content>y</Content></IndicatorItem></definition></ioc>"))
    rule = {r.doc: r for r in got.entities.collect()}
    assert {d: (r.name, r.description) for d, r in rule.items()} == {"d0": ("A & B", None), "d5": ("q", None), "d6": ("w", None)}
    assert sorted((r.name, r.value) for r in got.claims.collect() if r.doc == "d0") == [
        ("openioc.authored_by", "who"), ("openioc.indicator", "evil.example"), ("openioc.indicator", "md5:" + "a" * 32), ("openioc.last-modified", "2024"),
        ("openioc.unread", "Network/IP (not canonical), Network/URI (condition `contains`), Registry/Path"),
    ]
    assert [(r.kind, r.source_ref) for r in got.relationships.collect()] == [("indicates", rule["d0"].id)] * 2
    assert sorted((r.doc, r.reason) for r in got.rejects.collect()) == [("d1", "empty_document"), ("d2", "empty_document"), ("d3", "missing_identifier"), ("d4", "not_an_ioc"), ("d5", "no_indicator_items")]


def test_iodef(spark):
    got = xml.iodef(frame(spark, IODEF, "<IODEF-Document/>", "<Incident/>", "<a", None))
    assert sorted((r.doc, r.name, r.description) for r in got.entities.collect()) == [("d0", "CSIRT.example incident 17", "d"), ("d0", "unnamed-csirt incident 9", None)]
    assert sorted((r.name, r.value) for r in got.claims.collect()) == [
        ("iodef.address", "192.0.2.0/24"), ("iodef.address", "192.0.2.1"), ("iodef.address", "a@b.example"), ("iodef.impact.severity", "high"), ("iodef.purpose", "mitigation"),
        ("iodef.report_time", "t1"), ("iodef.unread", "Address `ipv6-addr` (not canonical), Address category `asn`"),
    ]
    ends = {r.id for r in got.entities.collect()}
    assert got.relationships.count() == 3 and {(r.kind, r.target_ref in ends) for r in got.relationships.collect()} == {("part_of", True)}
    assert sorted((r.doc, r.n, r.reason) for r in got.rejects.collect() if r.doc != "d0") == [("d1", 0, "no_incidents"), ("d2", 0, "not_iodef"), ("d3", 0, "unreadable_document"), ("d4", 0, "empty_document")]
    assert sorted(r.reason for r in got.rejects.collect() if r.doc == "d0") == ["empty_incident_id", "missing_incident_id"]


@pytest.mark.parametrize(
    "text, reason",
    [
        ("<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", "a document type"), ("<!DOCTYPE a SYSTEM 'file:///etc/passwd'><a/>", "a document type"), ("<a>&b;</a>", "not well-formed: undefined entity"),
        ("<a>" * 65 + "</a>" * 65, "nested too deeply"), ("<a>" + "<b/>" * 100_000 + "</a>", "too many elements"), ("<a>" + "x" * 65_537 + "</a>", "a text that is too long"),
        ("<a " + " ".join(f"b{i}=''" for i in range(65)) + "/>", "too many attributes"), ("<a></b>", "not well-formed: mismatched tag"), ("<a/><b/>", "not well-formed: junk after document element"), ("<a><b></a>", "not well-formed: mismatched tag"), ("<a>", "not well-formed: no element found"),
    ],
)
def test_refused(text, reason):
    with pytest.raises(xml.Unreadable, match=reason):
        xml.elements_of(text)


def test_at_the_limits():
    got = xml.elements_of("<a>" * 64 + "é" * 32_768 + "</a>" * 64)
    assert len(got) == 64 and got[0][:2] == (63, 63) and got[0][2] == list(range(63)) and len(got[0][5]) == 32_768
    assert len(xml.elements_of("<a>" + "<b/>" * 99_999 + "</a>")) == 100_000
    assert xml.elements_of("<a> x <b k='v'/> y\n</a>") == [(1, 1, [0], "b", [("k", "v")], ""), (0, 0, [], "a", [], "xy")]

"""Canonical forms of indicators as Column expressions; null where the text is not of the kind."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
DOMAIN = rf"^(?:{LABEL}\.)+[a-z](?:[a-z0-9-]{{0,61}}[a-z0-9])?$"
#: Length in hex digits by algorithm.
HASHES = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
#: Bracketed forms of dot, at, colon and slashes, in the order in which they are undone.
DEFANGED = [
    ("[dot]", "."), ("(dot)", "."), ("[.]", "."), ("(.)", "."), ("{.}", "."), ("[at]", "@"), ("(at)", "@"), ("[@]", "@"),
    ("[:]", ":"), ("[://]", "://"), ("[//]", "//"),
]


def _if(ok: Column, value: Column) -> Column:
    return F.when(ok, value)


def ipv4(raw: Column) -> Column:
    t = F.trim(raw)
    return _if(t.rlike(IPV4), t)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _hex_tail(text: Column) -> Column:
    """The text with a dotted IPv4 tail as two groups of hex digits."""
    pattern = rf"^([0-9a-f:]*:)({OCTET}(?:\.{OCTET}){{3}})$"

    def joined(o: Column) -> Column:
        two = lambda i: F.lower(F.hex(F.get(o, i).try_cast("bigint") * 256 + F.get(o, i + 1).try_cast("bigint")))
        return F.concat(F.regexp_extract(text, pattern, 1), two(0), F.lit(":"), two(2))

    return F.when(text.rlike(pattern), let(F.split(F.regexp_extract(text, pattern, 2), r"\."), joined)).otherwise(text)


def _groups(text: Column) -> Column:
    """The eight groups of an IPv6 address without leading zeros; null where the text is none."""
    cut = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

    def of_parts(halves: Column) -> Column:
        return let(F.struct(cut(F.get(halves, 0)).alias("l"), cut(F.get(halves, 1)).alias("r"), F.size(halves).alias("n")), of_halves)

    def of_halves(x: Column) -> Column:
        count = F.size(x["l"]) + F.size(x["r"])
        ok = ((x["n"] == 2) & (count <= 7)) | ((x["n"] == 1) & (count == 8))
        full = F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(8 - count, F.lit(0))), x["r"])
        return F.when(ok & F.forall(full, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", "")))

    return F.when(text.rlike("^[0-9a-f:.]+$"), let(F.split(_hex_tail(text), "::", -1), of_parts))


def _shortest(groups: Column) -> Column:
    """The groups as text, the first longest run of two or more zeros as a double colon."""

    def run(whole: Column) -> Column:
        out = whole
        for k in range(2, 9):
            out = F.when(whole.rlike(f"(:0){{{k}}}:"), F.regexp_replace(whole, f"^(.*?)(?::0){{{k}}}:(.*)$", "$1::$2")).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    return let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), run)


def ipv6(raw: Column) -> Column:
    """Shortest lower-case form; addresses that stand for an IPv4 address are refused."""

    def of_groups(g: Column) -> Column:
        zeros = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == "0")
        embedded = lambda text: (zeros(5) & (F.get(g, 5) == "ffff")) | (zeros(6) & ~text.isin("::", "::1"))
        return F.when(g.isNotNull(), let(_shortest(g), lambda text: F.when(~embedded(text), text)))

    return let(F.lower(F.trim(raw)), lambda t: let(_groups(t), of_groups))


def ip_address(raw: Column) -> Column:
    return F.coalesce(ipv4(raw), ipv6(raw))


def ipv6_range(raw: Column) -> Column:
    """IPv6 network with its host bits masked, group by group."""

    def of_text(t: Column) -> Column:
        bits = F.try_to_number(F.substring_index(t, "/", -1), F.lit("999")).cast("int")

        def masked(x: Column, i: Column) -> Column:
            size = F.pow(F.lit(2.0), 16 - F.least(F.greatest(bits - 16 * i, F.lit(0)), F.lit(16))).cast("bigint")
            return let(F.conv(x, 16, 10).cast("bigint"), lambda n: F.lower(F.hex(n - n % size)))

        found = let(_groups(F.substring_index(t, "/", 1)), lambda g: F.when(g.isNotNull(), F.concat(_shortest(F.transform(g, masked)), F.lit("/"), bits.cast("string"))))
        return F.when(t.rlike(r"^[^/]+/(?:12[0-8]|1[01]\d|[1-9]?\d)$"), found)

    return let(F.lower(F.trim(raw)), of_text)


def any_range(raw: Column) -> Column:
    return F.coalesce(ip_range(raw), ipv6_range(raw))


def ip_range(raw: Column) -> Column:
    """IPv4 network with its host bits masked."""
    t = F.trim(raw)
    parts = F.split(F.substring_index(t, "/", 1), r"\.")
    bits = F.try_to_number(F.substring_index(t, "/", -1), F.lit("99")).cast("int")
    number = sum((F.get(parts, i).try_cast("bigint") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, 0).try_cast("bigint") * 256**3)
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    low = number - number % size
    octets = [F.floor(low / 256 ** (3 - i)) % 256 for i in range(4)]
    ok = t.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}/(?:3[0-2]|[12]?\d)$")
    return _if(ok, F.concat(F.concat_ws(".", *(o.cast("bigint").cast("string") for o in octets)), F.lit("/"), bits.cast("string")))


def domain(raw: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(raw)), r"\.$", "")
    return _if((F.length(t) <= 253) & F.left(t, F.lit(254)).rlike(DOMAIN), t)


def email(raw: Column) -> Column:
    """Local part kept, domain in lower case, parted at the last at sign."""
    t = F.trim(raw)
    host = domain(F.substring_index(t, "@", -1))
    local = F.regexp_extract(t, r"^(.+)@[^@]*$", 1)
    return _if(local.rlike(r"^[^\s@\"(),:;<>\[\]\\]{1,64}$") & host.isNotNull(), F.concat(local, F.lit("@"), host))


def url(raw: Column) -> Column:
    """Scheme and host in lower case, default port dropped, an empty path as a slash."""
    t = F.trim(raw)
    pattern = r"^(?i)(https?|ftps?)://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::(\d{1,5}))?([/?#]\S*)?$"
    scheme, host, port, rest = (F.regexp_extract(t, pattern, i) for i in range(1, 5))
    scheme = F.lower(scheme)
    usual = F.when(scheme == "http", "80").when(scheme == "https", "443").when(scheme == "ftp", "21").otherwise("990")
    kept_port = F.when((port == "") | (port == usual), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest == "", F.lit("/")).when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return _if(t.rlike(pattern) & (F.octet_length(t) <= 8192), F.concat(scheme, F.lit("://"), F.lower(host), kept_port, path))


def file_hash(raw: Column) -> Column:
    """algorithm:hex, from an optional prefix or the length."""
    t = F.lower(F.trim(raw))
    digits = F.regexp_replace(t, r"^(md5|sha1|sha256|sha512):", "")
    stated = F.regexp_extract(t, r"^(md5|sha1|sha256|sha512):", 1)
    by_length = F.coalesce(*(F.when(F.length(digits) == n, F.lit(a)) for n, a in HASHES.items()))
    ok = digits.rlike("^[0-9a-f]+$") & by_length.isNotNull() & ((stated == "") | (stated == by_length))
    return _if(ok, F.concat(by_length, F.lit(":"), digits))


def cve(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return _if(t.rlike(r"^CVE-\d{4}-\d{4,}$"), t)


def cwe(raw: Column) -> Column:
    n = F.regexp_extract(F.upper(F.trim(raw)), r"^CWE-0*(\d+)$", 1)
    return _if(n != "", F.concat(F.lit("CWE-"), n))


def attack_id(raw: Column) -> Column:
    t = F.upper(F.trim(raw))
    return _if(t.rlike(r"^(T\d{4,}(\.\d{3})?|(TA|S|G|M)\d{4,})$"), t)


def mac(raw: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(raw), "-", ":"))
    return _if(t.rlike(r"^[0-9a-f]{2}(:[0-9a-f]{2}){5}$"), t)


def undefang(raw: Column) -> Column:
    t = F.regexp_replace(raw, r"(?i)hxxp(s?)://", "http$1://")
    for form, plain in DEFANGED:
        t = F.replace(t, F.lit(form), F.lit(plain))
    return t


def collapse(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def sanitised(raw: Column, chars: int) -> Column:
    """Without control characters, at most so many characters."""
    return F.left(F.regexp_replace(raw, r"\p{Cc}", ""), F.lit(chars))


def preview(raw: Column) -> Column:
    return sanitised(raw, 64)


def any_network(raw: Column) -> Column:
    """A range, address, URL, mail address or domain, by the shape of the text."""
    ranged = F.when(raw.contains("/") & ~raw.contains("://"), any_range(raw))
    rest = F.when(raw.contains("://"), url(raw)).when(raw.contains("@"), email(raw)).otherwise(domain(raw))
    return F.coalesce(ranged, ip_address(raw), rest)


def _plain(raw: Column, most: int) -> Column:
    """The trimmed text; null if it is empty, too long or has control characters."""
    t = F.trim(raw)
    return F.when((t != "") & (F.octet_length(t) <= most) & ~t.rlike(r"\p{Cc}"), t)


def file_name(raw: Column) -> Column:
    t = _plain(raw, 255)
    return F.when(~t.rlike(r"[/\\]"), t)


def file_path(raw: Column) -> Column:
    """posix: or windows: and the path; on Windows with back slashes and an upper-case drive."""
    t = _plain(raw, 4096)
    windows = t.rlike(r"^[A-Za-z]:") | t.startswith("\\\\") | t.startswith("//?/")
    back = F.replace(t, F.lit("/"), F.lit("\\"))
    drive = F.when(back.rlike(r"^[A-Za-z]:"), F.concat(F.upper(F.left(back, F.lit(1))), F.substring(back, 2, 1 << 20))).otherwise(back)
    return F.when(windows, F.concat(F.lit("windows:"), drive)).when(t.isNotNull(), F.concat(F.lit("posix:"), t))


def cpe(raw: Column) -> Column:
    """A CPE 2.3 formatted string of 13 components, its part in lower case."""
    parts = F.split(_plain(raw, 4096), ":", -1)
    ok = (F.size(parts) == 13) & (F.lower(F.get(parts, 0)) == "cpe") & (F.get(parts, 1) == "2.3") & F.lower(F.get(parts, 2)).isin("a", "o", "h", "*", "-")
    return F.when(ok, F.concat_ws(":", F.lit("cpe:2.3"), F.lower(F.get(parts, 2)), F.array_join(F.slice(parts, 4, 10), ":")))


def package_url(raw: Column) -> Column:
    pattern = r"^(?i:pkg:)/*([A-Za-z0-9.+-]+)/(.+)$"
    t = _plain(raw, 4096)
    return F.when(t.rlike(pattern), F.concat(F.lit("pkg:"), F.lower(F.regexp_extract(t, pattern, 1)), F.lit("/"), F.regexp_extract(t, pattern, 2)))


def container_image(raw: Column) -> Column:
    """Repository in lower case; tag and digest as they are."""
    pattern = r"^([^@]*?)(:[^@/:]*)?(@.*)?$"
    t = _plain(raw, 4096)
    name, tag, digest = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    return F.when((name != "") & (tag != ":") & (digest != "@"), F.concat(F.lower(name), tag, digest))


def cloud_resource(raw: Column) -> Column:
    """ARN with its first four fields in lower case, Azure id with its odd segments in lower case, other paths as they are."""
    t = _plain(raw, 4096)
    fields = F.split(F.substring(t, 5, 1 << 20), ":", 5)
    arn = F.when(F.size(fields) == 5, F.concat(F.lit("arn:"), F.array_join(F.transform(F.slice(fields, 1, 4), F.lower), ":"), F.lit(":"), F.get(fields, 4)))
    azure = F.array_join(F.transform(F.split(t, "/", -1), lambda x, i: F.when(i % 2 == 1, F.lower(x)).otherwise(x)), "/")
    return F.when(F.lower(t).startswith("arn:"), arn).when(t.startswith("/"), azure).when(t.contains("/"), t)


def kubernetes_resource(raw: Column) -> Column:
    parts = F.split(_plain(raw, 4096), "/", -1)
    ok = F.size(parts).isin(2, 3) & F.forall(parts, lambda x: x != "")
    return F.when(ok, F.concat_ws("/", F.lower(F.get(parts, 0)), F.array_join(F.slice(parts, 2, 2), "/")))


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(raw: Column) -> Column:
    """The instant of an RFC 3339 date-time; null for anything else, also without an offset."""
    t = F.trim(raw)
    return F.when(t.rlike(RFC3339), F.try_to_timestamp(F.upper(t)))


def has_non_utc_offset(raw: Column) -> Column:
    t = F.trim(raw)
    return ~F.lower(t).endswith("z") & F.regexp_replace(t, "^[^Tt]*[Tt]", "").rlike("[+-]")


def substring_bytes(raw: Column, start: int, length: int) -> Column:
    """Bytes start to start + length, drawn in to whole characters."""
    cut = F.substring(F.encode(raw, "UTF-8"), start + 1, length)
    inner = F.regexp_replace(F.hex(cut), "^(?:[89AB][0-9A-F])+", "")
    tail = r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"
    return F.decode(F.unhex(F.regexp_replace(inner, tail, "")), "UTF-8")


#: A chain of transforms is at most so long, and its output at most so many bytes.
MOST_TRANSFORMS, MOST_OUTPUT = 8, 8192


def transformed(raw: Column, steps: list[dict]) -> Column:
    """The text after a chain of transforms {"op": name, ...}; one that does not apply leaves it as it is."""
    out = raw
    for step in steps[:MOST_TRANSFORMS]:
        done = let(out, lambda o: _transform(o, step))  # noqa: B023
        out = let(done, lambda new: F.when(F.octet_length(new) > MOST_OUTPUT, substring_bytes(new, 0, MOST_OUTPUT)).otherwise(new))
    return out


def _transform(out: Column, arg: dict) -> Column:
    op = arg["op"]
    if op == "trim":
        return F.regexp_replace(out, r"^\s+|\s+$", "")
    if op == "lowercase":
        return F.translate(out, _UPPER, _LOWER)
    if op == "uppercase":
        return F.translate(out, _LOWER, _UPPER)
    if op == "strip_prefix":
        return F.when(out.startswith(arg["prefix"]), F.substring(out, len(arg["prefix"]) + 1, 1 << 30)).otherwise(out)
    if op == "strip_suffix":
        return F.when(out.endswith(arg["suffix"]), F.left(out, F.length(out) - len(arg["suffix"]))).otherwise(out)
    if op == "replace":
        return F.replace(out, F.lit(arg["from"]), F.lit(arg["to"])) if arg["from"] else out
    if op == "split_take":
        return F.coalesce(F.get(F.split(out, re.escape(arg["separator"]), -1), arg["index"]), out) if arg["separator"] else out
    if op == "substring":
        return substring_bytes(out, arg["start"], arg["length"])
    if op == "undefang":
        return undefang(out)
    if op == "collapse_whitespace":
        return collapse(out)
    raise ValueError(f"unknown transform {op!r}")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pattern_escaped(raw: Column) -> Column:
    """For a quoted value of an indicator pattern."""
    return F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def markdown_escaped(raw: Column) -> Column:
    """Signs of markup with a back slash in front, line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"([\\`*_{}\[\]()#+\-.!|<>~])", "\\\\$1")


def json_depth(text: Column) -> Column:
    """The deepest nesting of objects and arrays, in one pass over the brackets outside of strings."""
    # Possessive groups are matched in a loop, whatever the length of a string.
    bare = F.regexp_replace(F.regexp_replace(text, r'(?s)"(?:[^"\\]++|\\.)*+"', ""), r"[^{}\[\]]+", "")
    # An innermost pair goes in and out at once: without all but the way in, few brackets of a wide document are left.
    signs = F.regexp_replace(F.regexp_replace(F.translate(bare, "{}", "[]"), r"\[\](?=\[\])", ""), r"\]++$", "")
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("deepest"))

    def step(acc: Column, sign: Column) -> Column:
        here = acc["here"] + F.when(sign == "[", 1).when(sign == "]", -1).otherwise(0)
        return F.struct(here.alias("here"), F.greatest(acc["deepest"], here).alias("deepest"))

    return F.aggregate(F.split(signs, ""), start, step, lambda acc: acc["deepest"])


KINDS = {"ip_range": any_range, "ip_address": ip_address, "url": url, "email_address": email, "domain_name": domain, "file_hash": file_hash}


def address_kind(value: Column) -> Column:
    return F.when(value.contains(":"), "ipv6_address").otherwise("ipv4_address")


def infer(raw: Column) -> Column:
    """struct(kind, value, outcome): confident if one canonical form exists, ambiguous if several, none otherwise."""
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), f(raw).alias("value")) for k, f in KINDS.items())), lambda x: x["value"].isNotNull())
    outcome = F.when(F.size(found) == 1, "confident").when(F.size(found) > 1, "ambiguous").otherwise("none")
    one = F.size(found) == 1
    kind = F.when(found[0]["kind"] == "ip_address", address_kind(found[0]["value"])).otherwise(found[0]["kind"])
    return F.struct(F.when(one, kind).alias("kind"), F.when(one, found[0]["value"]).alias("value"), outcome.alias("outcome"))

"""Link columns: whole-column expressions over url strings, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
#: Characters that look like Latin letters and the digits used for letters, and what they stand for.
LOOK_FROM = "аеорсхуіјԁһӏѕԛԝɡոսορντκαειıł01345789"
LOOK_TO = "aeopcxyijdhlsqwgnuopvtkaeiiloleastbg"
#: Endings that reports find over-represented in abuse.
ABUSED = ("zip mov xyz top icu click gq tk ml cf ga buzz rest monster cyou sbs cfd lol bond quest support live shop online site fun win loan work cam bar email info").split()
#: Link shorteners.
SHORTENERS = (
    "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd cutt.ly rb.gy tiny.cc shorturl.at rebrand.ly bit.do s.id t.ly v.gd qrco.de shorturl.asia tiny.one bl.ink lnkd.in surl.li u.to clck.ru bitly.ws short.io linktr.ee urlz.fr shorte.st"
).split()
#: Words that scam links use.
URL_WORDS = (
    "login signin sign-in logon verify verification update secure security account kyc banking netbanking wallet bonus gift prize reward otp refund suspend suspended unlock confirm support helpdesk recover recovery reactivate claim challan aadhaar pan upi free win winner invoice payment billing"
).split()
#: Suffixes that ship with the library: (suffix, private). A fuller table is a parameter wherever sites are found.
SUFFIXES = [(s, False) for s in "com net org io dev app info xyz top co.uk org.uk co.in gov.in bank.in in uk de fr es".split()] + [(s, True) for s in "github.io web.app example.com example.net example.org".split()]
#: Query keys whose values are personal.
SENSITIVE_KEY = "(?i)token|key|auth|session|sid|pass|pwd|secret|code|otp|sig|email|mail|user|login|account|phone|mobile|jwt|ticket|nonce|state|card|pan|aadhaar|ssn"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MARK = "REDACTED"


def refang(c: Column) -> Column:
    out = F.regexp_replace(c, "(?i)^hxxp", "http")
    out = F.regexp_replace(out, r"(?i)\[\.\]|\(\.\)|\{\.\}|\[dot\]", ".")
    return F.regexp_replace(out, r"\[:\]", ":")


def defang(c: Column) -> Column:
    """The link with its scheme and host made harmless; path and query stay."""
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    safe = F.replace(F.regexp_replace(head, "(?i)^http", "hxxp"), F.lit("."), F.lit("[.]"))
    return F.concat(safe, F.substring(c, F.length(head) + 1, F.length(c)))


def authority(c: Column) -> Column:
    return F.regexp_extract(c, AUTHORITY, 1)


def host(c: Column) -> Column:
    """Lower-case host without user part, port and trailing dot; empty where there is none."""
    bare = F.regexp_replace(authority(c), r"^.*@", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r":[0-9]*$", "")), r"\.$", "")


def port(c: Column) -> Column:
    """The port, null if absent or 80 or 443."""
    p = F.try_to_number(F.nullif(F.regexp_extract(authority(c), r":([0-9]{1,5})$", 1), F.lit("")), F.lit("99999")).cast("int")
    return F.when(~p.isin(80, 443), p)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def fragment(c: Column) -> Column:
    return F.regexp_extract(c, r"#(.*)$", 1)


def reject_reason(c: Column) -> Column:
    """Why a cleaned link (see clean) is refused, null if it is fine."""
    h = host(c)
    octets = F.split(h, r"\.")
    a, b = octets[0].cast("int"), octets[1].cast("int")
    local = (a.isin(0, 10, 127) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224))
    return (
        F.when(c == "https://", "empty")
        .when(F.length(c) > 2048, "too long")
        .when(~c.rlike("^https?://"), "not a web link")
        .when((h == "") | h.rlike(r"\s"), "not a valid link")
        .when((h == "localhost") | h.endswith(".localhost"), "local address")
        .when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(local, "private address"))
        .when(~h.contains("."), "not a full address")
    )


def clean(c: Column) -> Column:
    """Trimmed and refanged, with a lower-case scheme; https where there was none."""
    bare = refang(F.trim(c))
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    other = bare.rlike(r"(?i)^(javascript|data|file|mailto|vbscript|blob|about|ftp|tel|sms|ws|wss|chrome|view-source):")
    return F.when(scheme != "", F.concat(F.lower(scheme), F.substring(bare, F.length(scheme) + 1, F.length(bare)))).when(other, bare).otherwise(F.concat(F.lit("https://"), bare))


def redact(c: Column) -> Column:
    """User part, e-mails in the path and telling values in the query give way to a mark."""
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1)
    auth = F.regexp_replace(authority(c), r"^.*@", MARK + "@")
    tokenish = lambda v: v.rlike(r"^[A-Za-z0-9_.=+/-]{24,}$") & v.rlike("[0-9]") & v.rlike("[A-Za-z]")

    def pair(p: Column) -> Column:
        k, v = F.regexp_extract(p, "^([^=]*)", 1), F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        return F.concat(k, F.lit("="), F.when(k.rlike(SENSITIVE_KEY) | (v.contains("@") & v.rlike(EMAIL)) | tokenish(v), MARK).otherwise(v))

    q = F.array_join(F.transform(F.filter(F.split(query(c), "&"), lambda p: p != ""), pair), "&")
    f = fragment(c)
    safe_f = F.when((f.contains("@") & f.rlike(EMAIL)) | f.contains("token"), MARK).otherwise(f)
    # Looking for e-mails in a long path takes the square of its length, so only where there can be one.
    safe_p = F.when(path(c).contains("@"), F.regexp_replace(path(c), EMAIL, MARK)).otherwise(path(c))
    return F.concat(head, auth, safe_p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(safe_f != "", F.concat(F.lit("#"), safe_f)).otherwise(""))


def host_suffixes(h: Column) -> Column:
    """The name and each of its parents, longest first."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def skeleton(c: Column) -> Column:
    return F.translate(F.lower(c), LOOK_FROM, LOOK_TO)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    letters = F.split(c, "")
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, x: a + share(x) * F.log2(share(x)))).otherwise(F.lit(0.0))


def looks_random(c: Column) -> Column:
    """Whether some part of ten or more ASCII characters looks machine-made."""

    def odd(t: Column) -> Column:
        letters = F.regexp_count(t, F.lit("[a-z]"))
        vowels = F.regexp_count(t, F.lit("[aeiou]"))
        switches = F.regexp_count(F.regexp_replace(t, "[0-9]+", "9"), F.lit("9")) * 2 - F.when(t.rlike("^[0-9]"), 1).otherwise(0) - F.when(t.rlike("[0-9]$"), 1).otherwise(0)
        few = (letters > 0) & (vowels / F.greatest(letters, F.lit(1)) < 0.2)
        return (F.length(t) >= 10) & ~t.rlike(r"[^\x00-\x7F]") & (entropy(t) >= 3.0) & (few | (switches >= 3) | t.rlike("[bcdfghjklmnpqrstvwxz]{6}"))

    return F.exists(F.split(F.lower(c), "[-_.]+"), odd)


def md5_long(c: Column) -> Column:
    """The first 64 bits of the md5 digest, signed."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, -10).cast("long")


def ip_number(c: Column) -> Column:
    p = F.split(c, r"\.")
    return F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long"))


#: Special IPv4 blocks, first and last address, and what they are; smaller blocks before those that hold them.
BLOCKS = [
    ("169.254.169.254", "169.254.169.254", "metadata"),
    ("0.0.0.0", "0.0.0.0", "unspecified"),
    ("192.0.0.9", "192.0.0.10", None),
    ("192.0.0.0", "192.0.0.255", "private"),
    ("192.0.2.0", "192.0.2.255", "private"),
    ("198.51.100.0", "198.51.100.255", "private"),
    ("203.0.113.0", "203.0.113.255", "private"),
    ("169.254.0.0", "169.254.255.255", "link-local"),
    ("192.168.0.0", "192.168.255.255", "private"),
    ("198.18.0.0", "198.19.255.255", "private"),
    ("172.16.0.0", "172.31.255.255", "private"),
    ("100.64.0.0", "100.127.255.255", "reserved"),
    ("0.0.0.0", "0.255.255.255", "private"),
    ("10.0.0.0", "10.255.255.255", "private"),
    ("127.0.0.0", "127.255.255.255", "loopback"),
    ("224.0.0.0", "239.255.255.255", "multicast"),
    ("240.0.0.0", "255.255.255.255", "private"),
]


def _blocked4(n: Column) -> Column:
    number = lambda a: sum(int(x) << s for x, s in zip(a.split("."), (24, 16, 8, 0)))
    out = F.lit(None).cast("string")
    for lo, hi, kind in reversed(BLOCKS):
        out = F.when(n.between(number(lo), number(hi)), F.lit(kind)).otherwise(out)
    return out


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ip6_groups(c: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address in any spelling, null for anything else."""
    pair = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535).cast("long"))))
    spelt = lambda t: F.when(t.contains("."), F.concat(F.regexp_replace(t, "[0-9.]+$", ""), bound(ip_number(F.regexp_extract(t, r"([0-9.]+)$", 1)), pair))).otherwise(t)
    part = lambda t, k: F.filter(F.split(F.coalesce(F.get(F.split(t, "::"), F.lit(k)), F.lit("")), ":"), lambda x: x != "")
    filled = lambda t: lambda s: F.concat(s["a"], F.array_repeat(F.lit("0"), F.when(t.contains("::"), 8 - F.size(s["a"]) - F.size(s["z"])).otherwise(0)), s["z"])
    groups = lambda t: F.transform(bound(F.struct(part(t, 0).alias("a"), part(t, 1).alias("z")), filled(t)), lambda x: F.conv(x, 16, 10).cast("int"))
    read = lambda t: F.when(t.rlike("^[0-9a-fA-F:]+$") & t.contains(":"), bound(groups(t), lambda g: F.when(F.size(g) == 8, g)))
    return bound(bound(F.regexp_replace(F.lower(c), "%.*$", ""), spelt), read)


def _blocked6(g: Column) -> Column:
    low = lambda i: g[i].cast("long") * 65536 + g[i + 1]
    zero = lambda at, n: F.forall(F.slice(g, at + 1, n), lambda x: x == 0)
    inner = (
        F.when(zero(0, 5) & (g[5] == 0xFFFF), low(6)).when(g[0] == 0x2002, low(1)).when((g[0] == 0x2001) & (g[1] == 0), F.lit(0xFFFFFFFF) - low(6))
        .when((g[0] == 0x64) & (g[1] == 0xFF9B) & zero(2, 4), low(6))
    )
    private = (
        g[0].between(0xFC00, 0xFDFF) | ((g[0] == 0x2001) & ((g[1] == 0xDB8) | (g[1] < 0x200))) | ((g[0] == 0x64) & (g[1] == 0xFF9B) & (g[2] == 1))
        | ((g[0] == 0x100) & zero(1, 3)) | ((g[0] == 0x3FFF) & (g[1] < 0x1000))
    )
    six = (
        F.when((g[0] == 0xFD00) & (g[1] == 0xEC2) & zero(2, 5) & (g[7] == 0x254), "metadata").when(zero(0, 7) & (g[7] == 1), "loopback").when(zero(0, 8), "unspecified")
        .when(g[0].between(0xFE80, 0xFEBF), "link-local").when(g[0] >= 0xFF00, "multicast").when(private, "private").when((g[0] < 0x2000) | g[0].between(0x4000, 0xFBFF) | g[0].between(0xFE00, 0xFE7F), "reserved")
    )
    return bound(inner, lambda n: F.when(n.isNotNull(), _blocked4(n)).otherwise(six))


def blocked(c: Column) -> Column:
    """Why an address is not public, null if it is (or is none); an IPv6 form that carries an IPv4 address is judged by that."""
    return F.when(c.contains(":"), bound(ip6_groups(c), _blocked6)).otherwise(bound(ip_number(c), _blocked4))


def parse_date(c: Column) -> Column:
    """A date in any of seven common spellings, null otherwise."""
    v = F.trim(c)
    forms = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "yyyy.MM.dd", "dd/MM/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in forms]).cast("date")

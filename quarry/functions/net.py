"""IPv4 and IPv6 addresses, URLs, ports, mail policy records, robots files and user agents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Well-known ports (port, service, transport, description).
PORTS = [
    (20, "FTP data", "TCP", "File transfer data channel"), (21, "FTP control", "TCP", "File transfer control channel"), (22, "SSH", "TCP", "Secure shell"), (23, "Telnet", "TCP", "Unencrypted remote terminal"),
    (25, "SMTP", "TCP", "Mail transfer"), (53, "DNS", "TCP/UDP", "Domain name system"), (67, "DHCP server", "UDP", "Dynamic host configuration"), (68, "DHCP client", "UDP", "Dynamic host configuration"),
    (80, "HTTP", "TCP", "Web traffic"), (110, "POP3", "TCP", "Mail retrieval"), (123, "NTP", "UDP", "Network time"), (143, "IMAP", "TCP", "Mail retrieval"), (161, "SNMP", "UDP", "Network management"),
    (389, "LDAP", "TCP", "Directory service"), (443, "HTTPS", "TCP", "Encrypted web traffic"), (445, "SMB", "TCP", "Windows file sharing"), (465, "SMTPS", "TCP", "SMTP over implicit TLS"), (587, "SMTP submission", "TCP", "Mail submission"),
    (993, "IMAPS", "TCP", "IMAP over TLS"), (995, "POP3S", "TCP", "POP3 over TLS"), (1433, "Microsoft SQL Server", "TCP", "Database service"), (3306, "MySQL", "TCP", "Database service"), (3389, "RDP", "TCP", "Remote desktop"),
    (5432, "PostgreSQL", "TCP", "Database service"), (6379, "Redis", "TCP", "In-memory data store"), (8080, "HTTP alternate", "TCP", "Common alternate web port"), (8443, "HTTPS alternate", "TCP", "Common alternate secure web port"), (27017, "MongoDB", "TCP", "Database service"),
]
#: Browser tokens in the order in which they decide; Safari has its version elsewhere.
BROWSERS = [("edge", "Microsoft Edge"), ("edga", "Microsoft Edge"), ("edgios", "Microsoft Edge"), ("edg", "Microsoft Edge"), ("opr", "Opera"), ("opera", "Opera"), ("firefox", "Firefox"), ("crios", "Chrome"), ("chrome", "Chrome"), ("version", "Safari")]


def ipv4_number(text: Column) -> Column:
    """The address as a number of 32 bits; null unless it is four decimal parts of at most 255 (leading zeros allowed)."""
    part = [F.try_to_number(F.regexp_extract(text, r"^\s*(\d+)\.(\d+)\.(\d+)\.(\d+)\s*$", k), F.lit("999999999")).cast("long") for k in range(1, 5)]
    fits = part[0].between(0, 255) & part[1].between(0, 255) & part[2].between(0, 255) & part[3].between(0, 255)
    return F.when(fits, part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def ipv4_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def ipv4_forms(number: Column) -> Column:
    """dotted, hexadecimal and binary forms."""
    return F.struct(ipv4_text(number).alias("dotted"), F.concat(F.lit("0x"), F.lpad(F.hex(number), 8, "0")).alias("hexadecimal"), F.lpad(F.bin(number), 32, "0").alias("binary"))


def ipv4_subnet(number: Column, prefix: Column) -> Column:
    """mask, network, broadcast, first and last host and their number; /31 has two hosts and /32 one."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (32 - prefix).cast("int"))
    network = number - F.pmod(number, size)
    last = network + size - 1
    wide = prefix < 31
    return F.struct(
        (F.lit(4294967296) - size).alias("mask"), network.alias("network"), last.alias("broadcast"),
        F.when(wide, network + 1).otherwise(network).alias("first_host"), F.when(wide, last - 1).otherwise(last).alias("last_host"), F.when(wide, size - 2).otherwise(size).alias("hosts"),
    )


def bound(value: Column, f) -> Column:
    """f of a value that its expression names many times, computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ipv6_expand(text: Column) -> Column:
    """Eight groups of four digits; null if the text is no address. A dotted tail counts as two groups."""
    tail = F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)
    pair = bound(ipv4_number(tail), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))
    bare = F.when(tail != "", F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), pair)).otherwise(text)
    groups = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ":", -1))

    def filled(half: Column) -> Column:
        """The two sides of ::, or the whole, with zeros between."""
        head, rest = groups(half[0]), groups(F.coalesce(F.get(half, 1), F.lit("")))
        missing = 8 - F.size(head) - F.size(rest)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(F.size(half) == 1, head).when((F.size(half) == 2) & (missing >= 1), F.concat(head, zeros, rest))

    good = lambda whole: (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return bound(bound(F.split(bare, "::", -1), filled), lambda w: F.when(good(w), F.array_join(F.transform(w, lambda g: F.lpad(F.lower(g), 4, "0")), ":")))


def ipv6_compress(text: Column) -> Column:
    """The shortest form: no leading zeros, the first longest run of two or more zero groups as ::."""

    def shortened(flat: Column) -> Column:
        out = flat
        for n in range(2, 9):  # the longest decides, so it comes last
            run = r"(^|:)0(:0){%d}(:|$)" % (n - 1)
            out = F.when(flat.rlike(run), F.regexp_replace(F.concat(F.regexp_extract(flat, "^(.*?)" + run, 1), F.lit("::"), F.regexp_replace(flat, "^.*?" + run, "")), ":::+", "::")).otherwise(out)
        return out

    return bound(F.array_join(F.transform(F.split(ipv6_expand(text), ":"), lambda g: F.regexp_replace(g, "^0{1,3}", "")), ":"), lambda flat: F.when(flat != "", shortened(flat)))


def url_parts(url: Column) -> Column:
    """scheme, host, path, query, number of query pairs, fragment and port (null if it isn't named) of an http or https URL; null for anything else."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    parts = F.struct(
        F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).alias("scheme"), F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), query.alias("query"),
        F.when(query.isNull() | (query == ""), 0).otherwise(F.size(F.split(query, "&"))).alias("pairs"), F.try_parse_url(url, F.lit("REF")).alias("fragment"),
        F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1).try_cast("int").alias("port"),
    )
    return F.when(url.rlike("(?i)^https?://"), parts)


def with_service(df: DataFrame, port: str) -> DataFrame:
    """df with service, transport and description of the port; service is `unknown` where it isn't listed."""
    known = df.sparkSession.createDataFrame(PORTS, "_port int, service string, transport string, description string")
    out = df.join(F.broadcast(known), F.col(port) == F.col("_port"), "left").drop("_port")  # the fixed list
    return out.fillna("unknown", ["service"])


def is_domain(text: Column) -> Column:
    """Two labels or more of letters, digits and inner hyphens, the last of letters alone, in 253 characters."""
    return (F.length(text) <= 253) & text.rlike(r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$")


def spf_record(mx: bool, a: bool, ip4: Column, include: Column, rest: str = "~all") -> Column:
    """v=spf1 with the terms asked for; ip4 (with a prefix of 0 to 32, if any) and include are arrays; null if one is wrong or over ten lookups are needed."""
    none = F.array().cast("array<string>")
    hosts = F.transform(F.coalesce(include, none), lambda d: F.regexp_replace(F.trim(d), "(?i)^include:", ""))
    nets = F.transform(F.coalesce(ip4, none), lambda x: F.trim(x))
    good = F.forall(hosts, is_domain) & F.forall(nets, lambda x: ipv4_number(F.substring_index(x, "/", 1)).isNotNull() & x.rlike(r"^[0-9.]+(/([0-9]|[12][0-9]|3[0-2]))?$")) & (F.size(hosts) + int(mx) + int(a) <= 10)
    named = lambda c, k: F.transform(c, lambda x: F.concat(F.lit(k + ":"), x))
    terms = F.concat(F.array(*map(F.lit, ["v=spf1", *(["mx"] if mx else []), *(["a"] if a else [])])), named(nets, "ip4"), named(hosts, "include"), F.array(F.lit(rest)))
    return F.when(good, F.array_join(terms, " "))


def dmarc_record(policy: Column, percent: Column, mail: Column) -> Column:
    """v=DMARC1; an unknown policy is quarantine, the percentage is held in 0 to 100, and reports go to a plain address only."""
    p = F.when(policy.isin("none", "quarantine", "reject"), policy).otherwise("quarantine")
    rua = F.when(mail.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(F.lit("rua=mailto:"), mail))
    return F.concat_ws("; ", F.lit("v=DMARC1"), F.concat(F.lit("p="), p), F.concat(F.lit("pct="), F.greatest(F.lit(0), F.least(F.lit(100), percent)).cast("string")), rua)


def robots_txt(agent: Column, allow: Column, disallow: Column, sitemap: Column) -> Column:
    """A robots file; paths without a leading / get one, and a sitemap must be http or https."""
    path = lambda word: lambda x: F.concat(F.lit(word), F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)))
    lines = F.concat(F.array(F.concat(F.lit("User-agent: "), agent)), F.transform(allow, path("Allow: ")), F.transform(disallow, path("Disallow: ")))
    return F.concat_ws("\n", F.array_join(lines, "\n"), F.when(sitemap.rlike("^https?://"), F.concat(F.lit("Sitemap: "), sitemap)))


def user_agent(text: Column) -> Column:
    """browser with version, system and device class of a user agent string, whatever its case; Unknown where nothing fits.

    A browser token decides only if a version follows its first place.
    """
    low = F.lower(F.trim(text))
    first = lambda token: F.regexp_extract(F.regexp_replace(low, rf"(?s)^.*?(?={token})", ""), rf"^{token}/([0-9.]+)", 1)
    name = F.lit("Unknown")
    for token, label in reversed(BROWSERS):
        hit = low.contains(token) & (first(token) != "") & (low.contains("safari") if label == "Safari" else F.lit(True))
        name = F.when(hit, F.concat(F.lit(label + " "), first(token))).otherwise(name)
    android, mac = F.regexp_extract(low, r"(?s)^(?:(?!android ).)*android ([0-9.]*)", 1), F.regexp_extract(low, r"(?s)^(?:(?!mac os x ).)*mac os x ([0-9_]*)", 1)
    system = (
        F.when(low.contains("windows nt 10"), "Windows 10/11").when(low.contains("windows nt 6.1"), "Windows 7").when(android.rlike("[0-9]"), F.concat(F.lit("Android "), android))
        .when(low.rlike("iphone|ipad|ipod"), "iOS / iPadOS").when(mac.rlike("[0-9]"), F.concat(F.lit("macOS "), F.replace(mac, F.lit("_"), F.lit(".")))).when(low.contains("linux"), "Linux").otherwise("Unknown")
    )
    device = F.when(low.contains("ipad"), "Tablet").when(low.rlike("mobile|iphone|android"), "Mobile").when(low.rlike("windows|macintosh|x11|linux"), "Desktop").otherwise("Unknown")
    return F.when(text.isNotNull(), F.struct(name.alias("browser"), system.alias("system"), device.alias("device")))


def query_pairs(query: Column) -> Column:
    """name and value of each pair of a query string, decoded as of a form; a part without = has an empty value."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda t: F.coalesce(F.try_url_decode(t), t)
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("name"), decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))


def with_query(base: Column, pairs: Column) -> Column:
    """A URL with pairs (name, value) as its query, before its fragment, after what query it has."""
    code = lambda t: F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))
    said = F.array_join(F.transform(pairs, lambda p: F.concat(code(p["name"]), F.lit("="), code(p["value"]))), "&")
    head, fragment = F.substring_index(base, "#", 1), F.regexp_extract(base, "(?s)(#.*)$", 1)
    return F.when(said == "", base).otherwise(F.concat(head, F.when(head.contains("?"), "&").otherwise("?"), said, fragment))

"""Scalar column functions: dates, encodings, names, identifiers, addresses, hashes."""

from __future__ import annotations

from ipaddress import IPv6Address

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.common import all_of, any_of

# --- fixed values: input patterns and limits -------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NAME_PATTERN = r"^[a-z0-9][a-z0-9-]*[a-z0-9]$"
NAME_MIN_LENGTH, NAME_MAX_LENGTH = 3, 63
CIDR_BROAD_ADDRESSES = 65_536
CIDR_MIN_PREFIX, CIDR_MAX_PREFIX = 8, 28
# IPv4 ranges counted as private, as (first address, prefix length).
PRIVATE_RANGES = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
)
# Addresses inside those ranges that are not private.
PUBLIC_EXCEPTIONS = (("192.0.0.9", 32), ("192.0.0.10", 32))
# The same for IPv6; mapped IPv4 addresses are judged as IPv4.
PRIVATE_RANGES_6 = (
    ("::1", 128),
    ("::", 128),
    ("64:ff9b:1::", 48),
    ("100::", 64),
    ("2001::", 23),
    ("2001:db8::", 32),
    ("2002::", 16),
    ("fc00::", 7),
    ("fe80::", 10),
)
PUBLIC_EXCEPTIONS_6 = (
    ("2001:1::1", 128),
    ("2001:1::2", 128),
    ("2001:3::", 32),
    ("2001:4:112::", 48),
    ("2001:20::", 28),
    ("2001:30::", 28),
)
MAPPED_PREFIX = "0" * 20 + "ffff"
# ----------------------------------------------------------------------------


def safe_ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded to ``digits``, 0 when there is nothing to divide by."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.coalesce(F.round(ratio, digits), F.lit(0.0))


def decode_text(encoded: Column) -> Column:
    """Base64 to UTF-8 text; NULL when the input is not valid base64."""
    return F.try_to_binary(encoded, F.lit("base64")).cast("string")


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_PATTERN), F.lit(False))


def name_valid(c: Column) -> Column:
    return F.coalesce(
        all_of([
            F.length(c).between(NAME_MIN_LENGTH, NAME_MAX_LENGTH),
            c.rlike(NAME_PATTERN),
            ~c.contains("--"),
        ]),
        F.lit(False),
    )


def resource_name_valid(c: Column, resource_type: str = "general") -> Column:
    """Name rules of a resource: general, ``s3`` (stricter) or ``lambda``."""
    tests = [c != "", F.length(c) <= NAME_MAX_LENGTH, c.rlike(NAME_PATTERN)]
    if resource_type == "s3":
        tests += [F.length(c) >= NAME_MIN_LENGTH, ~c.contains(".."), ~c.contains(".-"), ~c.contains("-."),
                  ~c.startswith("xn--"), ~c.endswith("-s3alias")]
    return F.coalesce(all_of(tests), F.lit(False))


def clean_name(c: Column) -> Column:
    """Lower-case, other characters to hyphens, hyphen runs to one, none at the ends."""
    hyphened = F.regexp_replace(F.lower(c), "[^a-z0-9-]", "-")
    return F.trim(F.regexp_replace(hyphened, "-+", "-"), F.lit("-"))


def content_hash(*columns: str) -> Column:
    """First 16 hex digits of the sha256 of the key-sorted JSON of the columns."""
    ordered = F.struct(*[F.col(c) for c in sorted(columns)])
    return F.substring(F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256), 1, 16)


def split_identifier(c: Column) -> Column:
    """Struct of the parts of ``p:a:b:c:d:type/name``; NULL with fewer than six parts."""
    parts = F.split(c, ":", -1)
    resource = F.get(parts, 5)
    slash = F.instr(resource, "/")
    has_name = slash > 0
    return F.when(
        F.size(parts) >= 6,
        F.struct(
            F.get(parts, 1).alias("partition"),
            F.get(parts, 2).alias("service"),
            F.get(parts, 3).alias("region"),
            F.get(parts, 4).alias("account_id"),
            F.when(has_name, F.substring_index(resource, "/", 1)).otherwise(resource).alias("resource_type"),
            F.when(has_name, resource.substr(slash + 1, F.length(resource))).otherwise(F.lit("")).alias("resource_name"),
        ),
    )


def nested_value(body: Column, dotted_path: str) -> Column:
    """Value at a dotted path of a JSON object, NULL when absent."""
    return F.get_json_object(body, "$" + "".join(f"['{p}']" for p in dotted_path.split(".")))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(c: Column) -> Column:
    """IPv4 text as a number, NULL when it is not an address."""
    parts = F.split(c, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, i).try_cast("long")
    return F.when(c.rlike(IPV4_PATTERN), number)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ipv6_hex(c: Column) -> Column:
    """IPv6 text as 32 hex digits, NULL when it is not an address."""
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    none = F.array().cast("array<string>")

    def dotted_tail(t: Column) -> Column:
        four = F.lower(F.lpad(F.hex(ipv4_number(t)), 8, "0"))
        return _once(four, lambda h: F.concat(F.substr(h, F.lit(1), F.lit(4)), F.lit(":"), F.substr(h, F.lit(5), F.lit(4))))

    def joined(parts: Column) -> Column:
        given = F.size(parts["l"]) + F.size(parts["r"])
        whole = F.concat(parts["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), parts["r"])
        fits = F.when(parts["short"], given <= 7).otherwise(given == 8)
        return F.when(fits, _once(whole, lambda w: F.when(
            F.forall(w, lambda g: F.length(g) <= 4), F.array_join(F.transform(w, lambda g: F.lpad(F.lower(g), 4, "0")), ""))))

    def expanded(body: Column) -> Column:
        fine = body.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & ~body.rlike(":::|::.*::|^:[^:]|[^:]:$")
        parts = F.struct(
            groups(F.substring_index(body, "::", 1)).alias("l"),
            F.when(body.contains("::"), groups(F.substring_index(body, "::", -1))).otherwise(none).alias("r"),
            body.contains("::").alias("short"))
        return F.when(fine, _once(parts, joined))

    body = F.when(c.contains("."), F.concat(
        F.regexp_extract(c, r"^(.*:)[0-9.]+$", 1), dotted_tail(F.regexp_extract(c, r"[0-9.]+$", 0)))).otherwise(c)
    return _once(body, expanded)


def ip_private(c: Column) -> Column:
    """Whether the IPv4 or IPv6 address lies in a private range; malformed text is not private."""
    bounds = lambda ranges: [
        (f"{int(IPv6Address(a)):032x}", f"{int(IPv6Address(a)) + 2 ** (128 - n) - 1:032x}") for a, n in ranges]

    def judged(six: Column) -> Column:
        inside = lambda ranges: any_of([six.between(lo, hi) for lo, hi in bounds(ranges)])
        return F.when(six.isNotNull() & ~six.startswith(MAPPED_PREFIX), inside(PRIVATE_RANGES_6) & ~inside(PUBLIC_EXCEPTIONS_6)
                      ).otherwise(_once(F.coalesce(F.conv(F.substr(six, F.lit(25), F.lit(8)), 16, 10).cast("long"), ipv4_number(c)), _private_4))

    return _once(ipv6_hex(c), judged)


def _private_4(number: Column) -> Column:

    def inside(ranges) -> Column:
        found = []
        for first, prefix in ranges:
            a, b, d, e = (int(x) for x in first.split("."))
            low = ((a * 256 + b) * 256 + d) * 256 + e
            found.append(number.between(low, low + 2 ** (32 - prefix) - 1))
        return any_of(found)

    return F.coalesce(inside(PRIVATE_RANGES) & ~inside(PUBLIC_EXCEPTIONS), F.lit(False))


def cidr_check(c: Column) -> Column:
    """Struct: is_valid, severity, num_addresses, prefix_warning.

    IPv4 with a prefix, a netmask or a host mask, and IPv6 with a prefix; a bare address is a
    network of one. More than 65,536 addresses is a warning; prefixes below 8 or
    above 28 set ``prefix_warning``. The number of addresses is NULL beyond a long.
    """
    address, given = F.substring_index(c, "/", 1), F.when(c.contains("/"), F.substring_index(c, "/", -1))
    width = F.when(ipv6_hex(address).isNotNull(), 128).when(address.rlike(IPV4_PATTERN), 32)

    def ones(bits: Column) -> Column:
        """Prefix length of a mask: ones and then zeros, or the reverse."""
        return F.when(bits.rlike("^1*0*$"), F.length(F.replace(bits, F.lit("0"), F.lit("")))).when(
            bits.rlike("^0+1+$"), F.length(F.replace(bits, F.lit("1"), F.lit(""))))

    def prefix(width: Column) -> Column:
        length = F.when(given.isNull(), width).when(given.rlike("^[0-9]{1,3}$"), given.try_cast("int")).when(
            width == 32, _once(F.lpad(F.bin(ipv4_number(given)), 32, "0"), ones))
        return F.struct(width.alias("width"), length.alias("length"))

    one_mask = F.length(F.regexp_replace(c, "[^/]", "")) <= 1
    return _once(_once(width, prefix), lambda p: _cidr_result(
        p["width"], p["length"], F.coalesce(one_mask & (p["length"] <= p["width"]), F.lit(False))))


def _cidr_result(width: Column, length: Column, valid: Column) -> Column:
    bits = F.when(valid, length)
    size = F.pow(F.lit(2.0), width - bits)
    addresses = F.when(width - bits < 63, size.cast("long"))
    severity = F.when(~valid, "ERROR").when(size > CIDR_BROAD_ADDRESSES, "WARNING").otherwise("INFO")
    return F.struct(
        valid.alias("is_valid"),
        severity.alias("severity"),
        addresses.alias("num_addresses"),
        F.coalesce((bits < CIDR_MIN_PREFIX) | (bits > CIDR_MAX_PREFIX), F.lit(False)).alias("prefix_warning"),
    )


def hive_path(ts: Column) -> Column:
    """``year=yyyy/month=MM/day=dd/hour=HH`` of a timestamp."""
    return F.date_format(ts, "'year='yyyy'/month='MM'/day='dd'/hour='HH")


def compact_date(ts: Column) -> Column:
    """``yyyyMMdd``, the date partition of change-feed files."""
    return F.date_format(ts, "yyyyMMdd")

"""Address functions against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from millrace.functions import scalar as S


def sample_6():
    rng = random.Random(7)
    heads = ["::", "::1", "fc00::", "fdff:1::2", "fe80::1", "febf::", "fec0::", "2001::", "2001:1::1", "2001:1::2", "2001:1::3", "2001:3::9",
             "2001:4:112::1", "2001:20::1", "2001:30::", "2001:db8::5", "2002::", "3fff::1", "3fff:fff::", "64:ff9b:1::", "64:ff9b::1", "100::1",
             "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:0808:0808", "1::8.8.8.8", "2600:1f18::1", "FE80::A"]
    random_ones = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)]
    return heads + random_ones + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)]


BAD_6 = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::", ":1::2", "1::2:", "::1.2.3",
         "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "1.2.3.4::"]


def judged(texts, kind):
    out = []
    for t in texts:
        try:
            out.append(kind(t))
        except ValueError:
            out.append(None)
    return out


def test_ipv6_addresses(spark):
    texts = sample_6() + BAD_6
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", S.ipv6_hex(F.col("t")).alias("h"), S.ip_private(F.col("t")).alias("p")).orderBy("i").collect()
    want = judged(texts, ipaddress.IPv6Address)
    assert [(t, r.h) for t, r in zip(texts, got)] == [(t, w and f"{int(w):032x}") for t, w in zip(texts, want)]
    assert [(t, r.p) for t, r in zip(texts, got)] == [(t, bool(w and w.is_private)) for t, w in zip(texts, want)]


def test_networks(spark):
    texts = ["10.0.0.0/24", "10.0.0.0/255.255.255.0", "10.0.0.0/0.0.0.255", "10.0.0.0/255.0.255.0", "10.0.0.0/0.0.0.0", "10.0.0.1", "10.0.0.0/33",
             "10.0.0.0/8/8", "fe80::/64", "fe80::1", "fe80::/129", "fe80::/112", "fe80::/111", "::/0", "x/8", "10.0.0.0/", "1.2.3.4/255.255.255.255"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.select("i", S.cidr_check(F.col("t")).alias("r")).orderBy("i").collect()]
    want = judged(texts, lambda t: ipaddress.ip_network(t, strict=False))
    assert [(t, r.is_valid) for t, r in zip(texts, got)] == [(t, w is not None) for t, w in zip(texts, want)]
    for t, r, w in zip(texts, got, want):
        if w is not None:
            assert r.num_addresses == (w.num_addresses if w.num_addresses < 2**63 else None), t
            assert r.severity == ("WARNING" if w.num_addresses > 65_536 else "INFO"), t

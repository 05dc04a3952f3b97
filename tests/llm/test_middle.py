"""Fill-in-the-middle against a plain walk over the units, and its edge cases."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import middle
from millrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(key, text):
    text = text or ""
    units, at = [], 0
    while at < len(text):
        end = at + 1
        if re.match("[A-Za-z]", text[at]):
            while end < len(text) and re.match("[A-Za-z]", text[end]):
                end += 1
        units.append(text[at:end])
        at = end
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, mid, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_registered_query_is_the_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, mid, output = brute(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, mid)
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id] or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_awkward_texts(spark):
    texts = [None, "", "a", "\n", "é\u0000x<", "<S", "S><P", "has <P> inside", "<M>", "𝒳𝒴 emoji 😀 z", "ab  cd\r\n\tef" * 3, "x" * 300_000,
             "word, " * 50_000, "same", "same"]
    rows = [(None if i == 3 else i % 5, t, "mine", 1) for i, t in enumerate(texts * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string, n long")
    cut = middle.fill_in_middle(docs)
    assert cut.columns == docs.columns
    got = cut.select("doc_id", "text", "n", "fim.*", middle.restore(F.col("fim.output"), F.col("fim.form")).alias("back"))
    got = got.toDF("doc_id", "text", "kept_n", "units", "form", "prefix", "middle", "output", "back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.units, r.form, r.prefix, r.middle, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.kept_n == 1
    assert middle.fill_in_middle(docs.where("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ<>PSM é\n 😀"), max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_lie_on_units(text, one, two):
    n, first, second = middle.cuts(text, one, two)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    assert n == len(units)
    assert text[:first] == "".join(units[:low]) and text[first:second] == "".join(units[low:high])


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62206320') as string) as text")
    cut = middle.fill_in_middle(docs, plain_percent=0)
    back = cut.select(F.hex(middle.restore(F.col("fim.output"), F.col("fim.form")).cast("binary"))).first()[0]
    assert back == "61FF62206320"


def test_one_python_step(spark):
    from conftest import plan_of

    plan = plan_of(QUERIES["op12_fill_in_middle"](spark, SF))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan

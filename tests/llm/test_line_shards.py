"""Line removal when more lines repeat than the heavy shard holds, against plain Python."""

from collections import defaultdict

from millrace.llm import line_dedup


def test_lines_outside_the_heavy_shard(spark):
    lines = [f"This repeated line is number {i} of them all" for i in range(2 * line_dedup.HEAVY)]
    rows = [
        (d, "\n".join([lines[(7 * d + 13 * j) % len(lines)] for j in range(40)] + [f"  Only the document {d} has it"]))
        for d in range(400)
    ]
    holders = defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            holders[line].add(d)
    assert sum(len(h) >= 3 for h in holders.values()) > line_dedup.HEAVY
    want = {
        d: "\n".join(x for x in text.split("\n") if len(holders[x]) < 3 or max(holders[x]) == d) for d, text in rows
    }
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_dropped == r.n_lines - (len(want[r.doc_id].split("\n")) if want[r.doc_id] else 0) for r in got)

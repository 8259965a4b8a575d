import random
import re
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionloom.llm.secrets import ownership, redact, scan, scan_rows, verdicts

PATTERNS = (
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)
PARTS = ["token", "Secret", " = ", ":", '"', "'", "AKIA", "A" * 13, "0123456789abcdef" * 2, "abc", " ", "password=", "é\U0001f600", "api_key", "\n", "x" * 9]


def brute(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=40, max_size=60))
def test_spans_equal_a_plain_scan(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in scan(rows).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["rank"] < 3] == brute(texts[r["i"]])


def test_widely_copied_values_are_examples(spark):
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    rows = [(i, f'token = "{key}"', f"owner{i % 4}/repo{i}") for i in range(8)] + [(9, 'secret: "Zx81Kq00Pp7mmQ"', "solo/repo"), (10, "password = aaaaaaaaaaaa", "solo/repo")]
    found = scan_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = verdicts(found, "rid", "source").select("span.kind", "span.value", "repositories", "owners", "verdict").distinct().collect()
    by_value = {r["value"]: r for r in out}
    assert by_value[key]["verdict"] == "example" and by_value[key]["owners"] == 4 and by_value[key]["repositories"] == 8
    assert by_value["Zx81Kq00Pp7mmQ"]["verdict"] == "live" and by_value["aaaaaaaaaaaa"]["verdict"] == "weak"


def test_ownership_counts_each_repository_once(spark):
    rows = spark.createDataFrame([("h", "a/x")] * 50 + [("h", "a/y"), ("h", None)], "hash string, repository string")
    (r,) = ownership(rows).collect()
    assert (r["repositories"], r["owners"], r["uses"]) == (3, 2, 52)


def test_redaction_joins_overlapping_ranges(spark):
    one = spark.createDataFrame([("0123456789é", [(2, 4), (3, 6), (8, 9), (2, 3)])], "text string, r array<struct<start:int,end:int>>")
    assert one.select(redact(F.col("text"), F.col("r"), "#")).first()[0] == "01#67#9é"


def test_odd_rows(odd_docs, no_docs):
    out = {(r["doc_id"], r["text"]): r["spans"] for r in scan(odd_docs).collect()}
    assert out[3, None] == [] and out[2, ""] == []
    (span,) = next(v for (i, _), v in out.items() if i == 7)
    assert (span["kind"], span["start"], span["end"], span["value"]) == ("assign", 0, 25, "abcdefgh12345678")
    assert scan(no_docs).count() == 0 and scan_rows(odd_docs).count() == odd_docs.count()


def _key(seed, lines=12):
    rng = random.Random(seed)
    alphabet = string.ascii_letters + string.digits + "+/"
    return ["".join(rng.choices(alphabet, k=64)) for _ in range(lines)] + ["Qz9=="]


def test_private_keys_are_whole_blocks(spark):
    first, last = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    keys = [_key(i) for i in range(5)]
    block = "\n".join([first, *keys[0], last])
    texts = [
        f"before {block} after",
        f"before {first}\\n" + "\\n".join(keys[0]) + f"\\n{last} after",  # the same key on one line
        "before " + "\r\n".join([first, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *keys[1], last]) + " after",
        "before " + "\n".join([first, *keys[2][:-1]]) + "\nand some words after",  # cut off
        "before " + "\n".join([first, *keys[3]]),
        f"such files start with {first} as a rule",
        "before " + "\n".join([first, *keys[4] * 4000, last]) + " after",
    ]
    rows = [(i, t, f"owner{i}/repo") for i, t in enumerate(texts)]
    found = scan_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("doc_id",))
    out = [r for r in verdicts(found, "doc_id", "source").collect() if r["span"]["kind"] == "pem"]
    by_doc = {r["doc_id"]: r for r in out}
    assert len(out) == len(texts) and {i: r["verdict"] for i, r in by_doc.items()} == {i: "weak" if i == 5 else "live" for i in range(7)}
    assert by_doc[0]["hash"] == by_doc[1]["hash"] and by_doc[0]["owners"] == 2
    assert len({r["hash"] for r in out}) == 6
    docs = spark.createDataFrame([(texts[i], [(r["span"]["value_start"], r["span"]["end"])]) for i, r in sorted(by_doc.items())], "text string, r array<struct<start:int,end:int>>")
    clean = [r[0] for r in docs.select(redact(F.col("text"), F.col("r"), "#")).collect()]
    assert clean[:5] == ["before # after"] * 3 + ["before #\nand some words after", "before #"] and clean[6] == "before # after"

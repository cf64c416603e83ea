import hashlib
import re

from facetframe.llm.secret_scan import scan_secrets, secret_digest

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [("assign", ASSIGN, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def plain(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, least) in enumerate(KINDS)
             for m in p.finditer(text or "") if len(m[g]) >= least]
    count = [sum(f[1] == k for f in found) for k in range(3)]
    return (*count, hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest(), [f[2] for f in sorted(found)])


def test_base_spans_and_ownership(spark, odd, odd_rows, none):
    key, live, copied = "AKIA" + "ABCD1234" * 2, "Zx9" + "qW3e" * 6, "Ab1" + "cD2f" * 6
    texts = [f"é☃ \U0001f600 password = 'hunter2hunter' {key}", "secret=token = abcdefgh", "Token: \"abc\" api_key:abcdef apikey='x.y=z/+-_'",
             "0123456789abcdef01234567 0123456789abcdef0123456", "AKIAAKIA" + "A" * 11, "passwd=" + "0a" * 20, f"see {live}.", f"{live} {live}",
             f"PASSWORD:{live}", "token==abcdef password=\n'abcdefg'", None, "", "x" * 30 + " " + "token=secret=abcdef"]
    rows = [(i, t, "own", "x", 1) for i, t in enumerate(texts)] + [(100 + i, f"a {copied} b", s, "x", 1) for i, s in enumerate(["own", "p", "q", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, base string, spans int").repartition(3)
    got = {r.doc_id: r for r in secret_digest(scan_secrets(docs)).collect()}
    for i, t, *_ in rows:
        a, k, h, sha, spans = plain(t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (a, k, h, sha), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("owned")] == spans
    assert "owned:4:31" in got[6].spans and got[7].spans == "owned:0:27,owned:28:55"
    assert "owned" not in got[8].spans                                # inside a base span
    assert all(got[100 + i].spans == "" for i in range(4))            # four owners: an example
    assert secret_digest(scan_secrets(odd)).count() == len(odd_rows) and scan_secrets(none).count() == 0


def test_copied_values_are_not_live(spark):
    value = "password=Example1234"
    docs = spark.createDataFrame([(i, value if i < 6 else "password=Mine98765", f"s{i % 3}") for i in range(8)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_live for r in secret_digest(scan_secrets(docs)).collect()}
    assert [got[i] for i in range(8)] == [0] * 6 + [1] * 2

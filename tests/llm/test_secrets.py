import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from merklake.llm import queries
from merklake.llm.secrets import BASE_KINDS, _BASE62, find_secrets, redact

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def checked(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = _BASE62[d] + digits
    return prefix + body + digits.rjust(6, "0")


def texts():
    rng = random.Random(2)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", ":", "=", "abc", "abcdef", "é", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "x", "日"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)]
    return [*out, None, "", "token: api:abcdefg", "token: token: abcdef", "A" * 300_000 + " password = hunter22", "f" * 100_000, "f" * 100_000]


def test_base_kinds_against_brute_force(spark, documents):
    given = texts()
    rows = find_secrets(documents(given), ["doc_id"]).orderBy("doc_id").collect()
    for text, r in zip(given, rows, strict=True):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.secrets if s.kind in BASE_KINDS] == brute(text)


def test_checksums(spark, documents):
    good = checked("ghp_", "aB3" * 10)
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abcdefghijklmnopqrstuv"
    given = [f"é {good}!", bad, checked("npm_", "z" * 30), jwt, jwt.replace("hbGci", "hbGcj"), "4111 1111 1111 1111", "4111 1111 1111 1112", "1 2 3"]
    rows = find_secrets(documents(given)).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.secrets] for r in rows] == [
        [("github", 2, 2 + len(good))], [], [("npm", 0, 40)], [("jwt", 0, len(jwt))], [], [("card", 0, 19)], [], [],
    ]


def test_redaction(spark, documents):
    docs = documents(["é token=deadbeefdeadbeefdeadbeef!", None, "none", "x password: hunter22\ny password: hunter23"]).withColumn("secrets", F.lit(1))
    got = redact(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["é [SECRET]!", None, "none", "x [SECRET]\ny [SECRET]"]
    assert redact(documents([])).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in base) for k in BASE_KINDS]
        assert set(base) <= set(r.spans.split(","))  or not base

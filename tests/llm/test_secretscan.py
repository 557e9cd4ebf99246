import hashlib
import random
import re

import pytest

from wavespan.llm import queries, secretscan


def literals(text):
    return [text[a:b] for a, b in sorted(secretscan.Lexer(text).run())]


@pytest.mark.parametrize("text, found", [
    ('db_password = "hunter2!x"', ["hunter2!x"]),
    ("dbPassword: 'S3cr3t!pass',", ["S3cr3t!pass"]),
    ('{"client-secret": "a8F3-kk29", "user": "joe"}', ["a8F3-kk29"]),
    ('cfg["api_key"] = "Zx81Qq7"', ["Zx81Qq7"]),
    ("export DB_PASSWORD=tr0ub4dor", ["tr0ub4dor"]),
    ("password: tr0ub4dor&3\nuser: joe", ["tr0ub4dor&3"]),
    ('let token: &str = "q9W8e7R6";', ["q9W8e7R6"]),
    ('#define API_KEY "k3y-k3y-k4z"', ["k3y-k3y-k4z"]),
    ('define("DB_PASSWORD", "w0rdPr3ss");', ["w0rdPr3ss"]),
    ('client.setPassword("w0rdPr3ss")', ["w0rdPr3ss"]),
    ("<password>w0rdPr3ss</password>", ["w0rdPr3ss"]),
    ('<add key="ApiKey" value="w0rdPr3ss"/>', ["w0rdPr3ss"]),
    ("- name: DB_PASSWORD\n  value: w0rdPr3ss", ["w0rdPr3ss"]),
    ("run --password w0rdPr3ss --user joe", ["w0rdPr3ss"]),
    ("url = postgres://joe:w0rdPr3ss@host/db", ["w0rdPr3ss"]),
    ('headers = {"Authorization": "Bearer a1b2c3d4e5"}', ["Bearer a1b2c3d4e5"]),
    ('key = """-----BEGIN RSA PRIVATE KEY-----\nMII\n"""\nprivate_key = key',
     ["-----BEGIN RSA PRIVATE KEY-----\nMII\n"]),
    # constants
    ('a = "w0rd"\nb = a + "Pr3ss"\npassword = b', ["w0rd", "Pr3ss"]),
    ('A = "w0rdPr3ss"\nconnect(password=A)', ["w0rdPr3ss"]),
    ('self.k = "w0rdPr3ss"\nlogin(secret=other.k)', ["w0rdPr3ss"]),
    ("V=w0rdPr3ss\nPASSWORD=${V}", ["w0rdPr3ss"]),
    ('x = "w0rdPr3ss"\nx = getenv("X")\npassword = x', []),
    ('password = ("w0rd"\n   "Pr3ss")', ["w0rd", "Pr3ss"]),
    ('password = b64decode("dzByZFByM3Nz")', ["dzByZFByM3Nz"]),
    # no secrets
    ('password = getenv("DB_PASSWORD")', []), ('password = "changeme"', []), ('max_tokens = "4096kk"', []),
    ('password_hint = "F1rst-Pet"', []), ("token: the word that he gave", []), ('name = "w0rdPr3ss"', []),
    ('password = "${DB_PASSWORD}"', []), ('password == "w0rdPr3ss"', []), ("Das Passwort: geheim.", []),
    ('public_key = "ssh-rsa-AAAA1"', []), ("password = None", []), ("it's the secret of don't: x", []),
])
def test_name_literal_pairs(text, found):
    assert literals(text) == found


def by_hand(text):
    """Base spans by trying every position."""
    out = []
    for k, (pattern, flags, group, least) in enumerate([
            (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
             re.I | re.A, 2, 12), (r"AKIA[A-Z0-9]+", 0, 0, 18), (r"[0-9a-f]+", 0, 0, 16)]):
        at = 0
        while at < len(text):
            m = re.compile(pattern, flags).match(text, at)
            if m and m.end() > at:
                if len(m.group(group)) >= least:
                    out.append((m.start(), k, m.end()))
                at = m.end()
            else:
                at += 1
    return sorted(out)


def test_base_spans_equal_every_position():
    rng = random.Random(6)
    parts = ["token", "Password", "paſſword", "secret", "api_key", "APIKEY", "=", ":", " ", '"', "'",
             "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "abcdef", "x", "É", "😀", "-", "ABCDEFGHIJKL",
             "a/b+c.d_e=f-g1", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sorted(secretscan.base_spans(text)) == by_hand(text)


def test_scan_reads_every_row(spark, odd_docs, docs, tmp_path):
    text = '😀 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" AKIAABCDEFGHIJKLMN'
    frame = odd_docs.unionByName(docs((20, text), (20, text), (21, "w " * 200_000 + text)))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_assignment_secrets(spark, str(tmp_path)).collect()
    assert len(rows) == frame.count()
    spans = "assign:2:51,literal:11:51,hex:11:51,access:53:71"
    for r in rows:
        if r.doc_id == 20:
            base = "assign:2:51,hex:11:51,access:53:71"
            assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert sorted(r.spans.split(",")) == sorted(spans.split(","))
        elif r.doc_id == 21:
            assert r.spans.startswith("assign:400002:400051,")
        else:
            assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (0, 0, 0, "")
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest()
    docs().write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_assignment_secrets(spark, f"{tmp_path}/none").count() == 0

"""Secrets are found and redacted to their ends: bodies of private keys, logins of any length."""

from __future__ import annotations

import pytest

from tests.llm.test_llm_operators import frame
from tramaline.llm import secret_scan

LINES = ["MIIEvQ" + c * 58 for c in "abcDEF"] + ["q83vEjRWeJA="]
HEAD, TAIL = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
BODIES = {
    "whole": (f"{HEAD}\n" + "\n".join(LINES) + f"\n{TAIL}", " and more."),
    "headers": (f"{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + "\n".join(LINES) + f"\n{TAIL}", "\nafter"),
    "one line": (f"{HEAD} " + " ".join(LINES) + f" {TAIL}", " after it"),
    "escaped": (f"{HEAD}\\n" + "\\n".join(LINES) + f"\\n{TAIL}", '\\n", "x": 1'),
    "no end": (f"{HEAD}\r\n" + "\r\n".join(LINES), "\r\nThen prose goes on."),
    "no end, headers": (f"{HEAD}\nProc-Type: 4,ENCRYPTED\n\n" + "\n".join(LINES), "\nThen prose goes on."),
    "no end, escaped": (f"{HEAD}\\n" + "\\n".join(LINES), '", next'),
    "cut off": (f"{HEAD}\n" + "\n".join(LINES[:3]), ""),
    "head only": (HEAD, " is how a key begins."),
    "jwt": ("https://" + "u" * 70 + ":" + "eyJ" + "a1" * 60 + ".eyJ" + "b2" * 90 + "@", "host/path"),
    "token of 93": ("https://git:" + "t" * 93 + "@", "host/path"),
}


@pytest.mark.parametrize("case", BODIES)
def test_to_its_end(spark, case):
    secret, after = BODIES[case]
    kind = "url_login" if "://" in secret else "private_key"
    docs = frame(spark, [(1, f"Été before {secret}{after}"), (2, f"{secret}{after}\n{secret}{after}")])
    found = {r.doc_id: r.spans.split(",") for r in secret_scan.find_secrets(docs).collect()}
    assert f"{kind}:11:{11 + len(secret)}" in found[1]
    second = len(secret) + len(after) + 1
    assert {f"{kind}:0:{len(secret)}", f"{kind}:{second}:{second + len(secret)}"} <= set(found[2])
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    mark = f"[{kind.upper()}]"
    assert clean[1] == f"Été before {mark}{after}"
    assert clean[2] == f"{mark}{after}\n{mark}{after}"

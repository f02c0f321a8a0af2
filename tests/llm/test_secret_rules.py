"""Every further rule finds its tokens, and nothing in prose."""

from __future__ import annotations

from tests.llm.test_llm_operators import frame, prose
from tramaline.llm import secret_scan

A = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3gI5kL7nO9qR1tU3wX5z"
H = "0123456789abcdef" * 4
TOKENS = {
    "age": "AGE-SECRET-KEY-1" + A.upper()[:50],
    "azure": "AccountKey=" + (A + A)[:86] + "==",
    "databricks": "dapi" + H[:32],
    "digitalocean": "dop_v1_" + H,
    "docker": "dckr_pat_" + A[:27],
    "github": "ghs_" + A[:36],
    "gitlab": "glpat-" + A[:20],
    "google": "AIza" + A[:35],
    "huggingface": "hf_" + A[:34],
    "mailgun": "key-" + H[:32],
    "npm": "npm_" + A[:36],
    "pypi": "pypi-AgEI" + A,
    "sendgrid": "SG." + A[:22] + "." + A[:43],
    "shopify": "shpat_" + H[:32],
    "slack": "xoxb-" + A[:24],
    "slack_hook": "hooks.slack.com/services/T0000/B0000/" + A[:24],
    "square": "sq0csp-" + A[:43],
    "stripe": "sk_live_" + A[:24],
    "telegram": "123456789:AA" + A[:33],
}


def test_each_rule(spark):
    kinds = {r.kind for r in secret_scan.EXTRA}
    assert set(TOKENS) | {"private_key", "jwt", "url_login"} == kinds
    docs = [(i, f"{prose(i, 12)} {t}\n{prose(i + 50, 12)}") for i, t in enumerate(TOKENS.values())] + [(900, prose(3, 4000))]
    got = {r.doc_id: r for r in secret_scan.find_secrets(frame(spark, docs)).collect()}
    for i, (kind, token) in enumerate(TOKENS.items()):
        at = docs[i][1].index(token)
        assert f"{kind}:{at}:{at + len(token)}" in got[i].spans.split(","), kind
    assert got[900].spans == ""
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(frame(spark, docs)).collect()}
    assert not [k for i, (k, t) in enumerate(TOKENS.items()) if t[-12:] in clean[i]] and clean[900] == docs[-1][1]

"""Planted secrets that no base pattern matches, beside strings that only look like some."""

import base64
import random

from tests.llm.texts import frame, sentences

from skyloom.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(rng):
    key = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    return rng.choice([
        f'client_id = "{key(24)}"', f"Authorization: Bearer {key(32)}", f"postgres://admin:{key(20)}@db.host/main",
        f"ghp_{key(36)}", f"credentials are {key(22)}", f"https://api.host/v1?sig={base64.b64encode(rng.randbytes(24)).decode()}", f"pwd: {key(18)}", f"xoxb-{key(28)}",
    ])


def harmless(rng):
    words = ["user", "account", "session", "config", "server", "module", "value", "index", "handler", "service", "default", "request"]
    name = lambda n: "_".join(rng.choice(words) for _ in range(n))
    n = rng.randrange(10, 99)
    return rng.choice([
        f"{name(3)}_{n} = {name(4)}_{n}", f'path = "/usr/local/{name(2)}/{name(2)}{n}/{name(1)}"', "date: 2024-01-%02dT00:00:00" % rng.randrange(1, 29),
        f"https://www.example.com/{name(2)}/{name(2)}{n}.html", f"version = {n}.0.0-default-server-{n}", "code: aaaaaaaaaaaaaaaaaaaaaa1", f"'{name(4)}{n}'",
    ])


def test_recall_and_precision(spark):
    rng = random.Random(3)
    docs, want = [], {}
    for i in range(600):
        what = planted(rng) if i % 2 else harmless(rng)
        before = sentences(1000 + i, 40) + " "
        docs.append((i, before + what + " " + sentences(2000 + i, 40)))
        want[i] = (len(before), len(before) + len(what)) if i % 2 else None
    found = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, docs)).collect()}
    hit = lambda i: any(s.startswith("novel") and want[i] and want[i][0] <= int(s.split(":")[1]) and int(s.split(":")[2]) <= want[i][1] for s in found[i]["spans"].split(","))
    caught = sum(hit(i) for i in want if want[i])
    wrong = [docs[i][1][200:300] for i in want if not want[i] and found[i]["n_novel"]]
    assert caught >= 0.95 * 300, caught
    assert len(wrong) <= 0.02 * 300, wrong[:5]

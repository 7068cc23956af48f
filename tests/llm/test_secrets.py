import random
import re
import string

import pytest

from pulsegrid.llm import secrets
from tests.llm.cases import awkward, documents, empty, rows


def brute(text):
    text, found = text or "", []
    key = "password|passwd|secret|token|api_?key"
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in key)
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append(("assign", m.start(), m.end()))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    found.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
    counts = [sum(s[0] == k for s in found) for k in ("assign", "access", "hex")]
    return (*counts, ",".join(f"{k}:{a}:{b}" for k, a, b in found))


@pytest.mark.parametrize("make", [awkward, documents, empty])
def test_base_matches_brute_force(spark, make):
    docs = make(spark)
    got = secrets.scan(docs)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base") == want
    for r in got.collect():  # base spans stay
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_token_efficiency():
    count = secrets._counter("byte_bpe_50k.tiktoken")
    find = lambda t: secrets.token_spans(t, count, 2.2, 3.0)
    assert find("key aB3dE5fG7hJ9kL1mN2pQ4rS6 end") == [("random", 4, 28)]
    assert not find("d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000")
    assert not find("internationalization2 some_long_identifier_name42 HttpRequestHandler2Factory")
    assert not find("1111111111111111111111a aaaaaaaaaaaaaaaaaaaaaaaaaaa1 2024-01-01-12-30-00-00")


def test_random_strings_of_every_form_are_found():
    """Letters only, upper-case hex keys and long keys with a hex run inside; brute force over the text."""
    count, rng = secrets._counter("byte_bpe_50k.tiktoken"), random.Random(11)
    letters, digits = string.ascii_letters, string.digits
    makers = {
        "letters": lambda: "".join(rng.choices(letters, k=24)),
        "base62": lambda: "".join(rng.choices(letters + digits, k=20)),
        "upper hex": lambda: "".join(rng.choices("0123456789ABCDEF", k=32)),
    }
    for name, make in makers.items():
        keys = [make() for _ in range(200)]
        found = 0
        for key in keys:
            text = f"the value {key} was seen"
            base, more = secrets.all_spans(text, count, 2.2, 3.0)
            found += any(a <= 10 and b >= 10 + len(key) for _, a, b in base + more)
        assert found >= 190, (name, found)
    for _ in range(50):
        head, tail = ("".join(rng.choices("GHJKMNPQRSTVWXYZ23456789", k=20)) for _ in range(2))
        key = head + "".join(rng.choices("0123456789abcdef", k=32)) + tail
        base, more = secrets.all_spans(f"a {key} b", count, 2.2, 3.0)
        covered = {i for _, a, b in base + more for i in range(a, b)}
        assert covered == set(range(2, 2 + len(key)))
        assert all(y[1] >= x[2] for x, y in zip(sorted(base + more, key=lambda s: s[1]), sorted(base + more, key=lambda s: s[1])[1:]))


def test_digests_and_names_are_left_alone():
    count = secrets._counter("byte_bpe_50k.tiktoken")
    find = lambda t: secrets.all_spans(t, count, 2.2, 3.0)[1]
    value = "9F86D081884C7D659A2FEAA0C55AD015"
    assert find(f"x {value} y") == [("random", 2, 34)]
    for name in ("md5: ", "MD5(", "sha-256=", 'checksum "', "commit "):
        assert not find(f"{name}{value}")
    assert not find("Donaudampfschifffahrtsgesellschaft src/main/resources/application internationalisation")
    assert not find("my_service_api_key=9f86d081884c7d659a2feaa0c55ad015")


def test_redact(spark):
    docs = awkward(spark)
    out = {(r.doc_id, r["key"]): r for r in secrets.redact(docs).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        now = out[r.doc_id, r["key"]]
        if brute(r.text)[3]:
            assert "[secret]" in now.text and not brute(now.text)[3] and now.n_chars == len(now.text)
        else:
            assert now.text == r.text or "[secret]" in now.text

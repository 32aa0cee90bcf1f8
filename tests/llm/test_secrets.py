import random
import re
import string

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import secrets

from .helpers import ODD, docs

PATH = P.path("byte_bpe_50k.tiktoken")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def encode(text):
    return secrets.vocabulary(PATH, P.PATTERN).encode_ordinary(text)


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


PART = st.sampled_from(["token", "PassWord", "ſecret", "apiKey", "api_key", '"', "'", " ", ":", "=", "abcdef", "AKIA" + "Q7" * 9, "AKIA", "0f" * 13, "é", "\n", "x", "K" * 3, "-", "+/"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=12))
def test_base_spans(parts):
    text = "".join(parts)
    assert [s for s in secrets.scan(text, encode) if s[0] != "random"] == brute(text)


def test_random_strings_and_what_is_not():
    r = random.Random(4)
    for n in (24, 32, 64):
        for _ in range(50):
            run = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
            assert secrets.scan(f"see {run}.", encode)[0] == ("random", 4, 4 + n)
    for run in ("0123456789abcdef" * 2, "550e8400-e29b-41d4-a716-446655440000", "getUserNameFromSessionContext", "some_long_snake_case_name_2024", "a" * 50, "-" * 5000 + "9", "1234567890" * 5, "internationalisation" * 2, "=" * 40):
        assert not [s for s in secrets.scan(run, encode) if s[0] == "random"], run


def test_table(spark):
    texts = [*ODD, (20, "token = 'abcdefgh' AKIA" + "A1" * 10)]
    got = secrets.secret_spans(docs(spark, texts), PATH, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), len(r["spans"])) for r in got) == sorted((str(i), len(secrets.scan(t or "", encode))) for i, t in texts)
    assert secrets.secret_spans(docs(spark, []), PATH, P.PATTERN).count() == 0

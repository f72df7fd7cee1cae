"""Planted secrets outside the known patterns: recall of each shape, and false alarms on prose."""

import random
import string

import pytest

from stockloom.llm import secrets

LETTERS = string.ascii_letters + string.digits
SHAPES = {
    "camel case": ('clientSecretKey: "{}"', 32, LETTERS),
    "password of a URL": ('db = "postgres://admin:{}@db.host/x"', 14, LETTERS + "!$*"),
    "marks": ("passphrase = '{}'", 18, LETTERS + "!@#$%&*"),
    "bare prefix": ("see ghp_{} here", 36, LETTERS),
    "header": ("Authorization: Bearer {}", 40, LETTERS + "-_."),
    "PEM block": ("-----BEGIN PRIVATE KEY-----\n{}\n-----END PRIVATE KEY-----", 64, LETTERS + "+/"),
    "next line": ("signing key:\n  {}", 44, LETTERS),
    "far from its name": ("the session cookie that the gateway hands out to a browser after it has signed in, and which is sent back, was {}", 40, LETTERS),
    "short": ("pwd: '{}'", 12, LETTERS + "!@#$%&*"),
}
PROSE = "the of and to in that thing was for on with this have from anon ering thent olyer account access session token about".split()


@pytest.fixture(scope="module")
def novelty(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(PROSE) for _ in range(80))) for i in range(50)], "doc_id long, text string")
    words = secrets.corpus_words(docs)
    assert set(words) == {w for w in PROSE if len(w) > 2}
    return secrets.Novelty(words)


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


@pytest.mark.parametrize("shape", SHAPES)
def test_planted_secrets_are_found(novelty, shape):
    rng = random.Random(shape)
    form, length, alphabet = SHAPES[shape]
    found = 0
    for _ in range(200):
        value = "".join(rng.choice(alphabet) for _ in range(length))
        text = prose(rng, 30) + "\n" + form.format(value) + "\n" + prose(rng, 20)
        start = text.index(value)
        found += any(a <= start + 1 and b >= start + length - 2 for a, _, b in secrets.find_spans(text, novelty)[1])
    assert found >= 180


def test_clean_texts_are_left_alone(novelty):
    rng = random.Random(9)
    lines = [
        "account: first_name.last_name@example.com and 192.168.100.200 for the session", "access https://example.com/docs/session/token/about?page=account",
        "token = get_access_token_from_session(account)", "key: ................................", "the password: aaaaaaaaaaaaaaaaaaaaaaaa",
        "class AccountSessionTokenFactoryBuilder(AbstractSessionAccess):", "api_key = os.environ['ACCOUNT_ACCESS_TOKEN_NAME']", "token: 1234567890",
    ]
    for line in lines:
        for _ in range(20):
            text = prose(rng, 20) + "\n" + line + "\n" + prose(rng, 20)
            assert not secrets.novel_spans(text, [], novelty), line


def test_a_copied_secret_does_not_make_itself_known(spark):
    value = "Zx81Qm4TtP0vR7bN2kLw9Yd3"
    docs = spark.createDataFrame([(i, f"the session key: {value} of the account") for i in range(200)], "doc_id long, text string")
    assert {r["n_novel"] for r in secrets.scan(docs).collect()} == {1}

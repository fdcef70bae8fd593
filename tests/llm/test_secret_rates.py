"""How much of planted random strings op7 finds."""

import random
import string

import pytest

from codeloom.llm.secrets import spans_of, vocabulary

MIXED = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def rate(coder, alphabet, length, prefix="", n=300):
    draw = random.Random(length)
    found = 0
    for _ in range(n):
        text = "see " + prefix + "".join(draw.choices(alphabet, k=length)) + " here"
        found += any(k == 3 and b == 4 + len(prefix) + length for _, k, b in spans_of(text, coder))
    return found / n


@pytest.mark.parametrize("alphabet", [string.ascii_lowercase, string.ascii_uppercase, MIXED])
@pytest.mark.parametrize("length", [16, 19, 20, 32, 64])
def test_random_strings_are_found(coder, alphabet, length):
    assert rate(coder, alphabet, length) > 0.85


@pytest.mark.parametrize("prefix", ["connection_string=", "path/to/some/configuration/", "production_database_connection_"])
def test_words_before_do_not_hide(coder, prefix):
    assert rate(coder, MIXED, 24, prefix) > 0.98
    assert rate(coder, string.ascii_lowercase, 24, prefix) > 0.85


def test_names_digests_and_numbers_stay(coder):
    for text in ("user_name_with_long_words", "2024-01-02-11-22-33", "src/main/java/com/example/app", "getElementsByClassName", "INTERNATIONALIZATION", "4929123456781234567", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "etag=DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "123e4567-e89b-12d3-a456-426614174000"):
        assert spans_of(text, coder) == [], text

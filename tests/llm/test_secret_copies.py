"""Keys that stand several times, and keys of several alphabets."""

import random
import string

import pytest

from tallysieve.llm import secrets

RNG = random.Random(4)
PROSE = "the team writes clear notes about plans for next week and shares them with everyone who asks in the long meeting".split()
ALPHABETS = {"base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "BASE36": string.ascii_uppercase + string.digits, "base62": string.ascii_letters + string.digits, "hex": "0123456789abcdef"}


def prose(n):
    return " ".join(RNG.choices(PROSE, k=n))


def key(alphabet, n):
    return "".join(RNG.choices(alphabet, k=n))


def found(text):
    return [text[i:j] for i, j, *_ in secrets.spans_of(text, text.encode())]


@pytest.mark.parametrize("copies", [2, 3, 10, 50])
@pytest.mark.parametrize("between", [0, 5, 60])
def test_all_copies_of_a_key_are_found(copies, between):
    for _ in range(10):
        own = key(ALPHABETS["base62"], 30)
        text = prose(20) + "".join(f" my secret is {own} {prose(between)}" for _ in range(copies))
        assert found(text) == [own] * copies


@pytest.mark.parametrize("size", [16, 20, 32, 52, 64])
@pytest.mark.parametrize("alphabet", sorted(ALPHABETS))
def test_recall_of_alphabets(alphabet, size):
    keys = [key(ALPHABETS[alphabet], size) for _ in range(200)]
    hits = sum(own in found(f"{prose(30)} my secret is {own} {prose(30)}") for own in keys)
    assert hits >= 0.9 * len(keys)


def test_recall_of_uuids():
    keys = ["-".join(key(ALPHABETS["hex"], n) for n in (8, 4, 4, 4, 12)) for _ in range(200)]
    assert sum(own in found(f"{prose(30)} my secret is {own} {prose(30)}") for own in keys) >= 0.9 * len(keys)


def test_names_numbers_and_times_are_no_keys():
    names = ["20240101T120000Z", "2024-01-01T00:00:00Z", "internationalization", "getUserAccountName", "MAX_RETRY_COUNT_3", "v2.14.0-beta.3", "550012345678", "SHA256withRSA", "HttpServletRequestWrapper", "ISO-8859-15", "customer_address_line_2"]
    shown = [n for n in names for _ in range(20) if found(f"{prose(30)} the token is {n} and again the token is {n} {prose(20)}")]
    assert len(shown) <= 0.05 * 20 * len(names)

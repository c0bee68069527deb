import pytest

from tessella.llm import secrets

NOISE = "q8Zt3vXw0LmYpR5sKd7NhG2b"
HEX = "0123456789abcdef"


@pytest.mark.parametrize(
    "text, want",
    [
        (f"x {NOISE[:16]} y", [(2, 18)]),  # a bare short key
        (f"/releases/documentation/installation/configuration/{NOISE}/instructions", [(51, 75)]),  # inside a readable path
        (f"{HEX}{NOISE} z", [(16, 40)]),  # the rest beside a base span
        (f"{NOISE}+{HEX}", [(0, 25)]),
        (NOISE, [(0, 24)]),
        (f"password={NOISE}", []),  # a base span, whole
        ("release_notes_for_version_2024_01 internationalization20 x_internationalize2day", []),
        ("123e4567-e89b-12d3-a456-426614174000", []),
        ("d41d8cd98f00b204e9800998ecf8427e", []),
        ("short9key", []),
    ],
)
def test_random_spans(text, want):
    assert [(s, e) for s, _, e in secrets.random_spans(text, secrets.base_spans(text))] == want


def test_no_part_of_a_key_beside_hex_is_left():
    assert secrets.redacted(f"a {HEX}{NOISE} b") == "a [secret][secret] b"

"""Telephone numbers in their common notations get surrogates."""

import re

import pytest

from phonosearch.llm import pii

PHONES = [
    "+14155552671", "+4915112345678", "+49 30 1234567", "+49 170 1234567", "+44 7911 123456", "+33 6 12 34 56 78", "+33 1 42 68 53 00",
    "555 123 4567", "555-123-4567", "(415) 555 0101", "+3 (415) 555-0101", "+1.415.555.2671", "0170 1234567", "01 42 68 53 00", "020 7946 0958", "+12 34 56",
]
OTHERS = ["in 2024 there were 1500 of 20000", "01.02.2023 12:30", "2023-01-02", "1 + 2 = 3", "version 1.2.3", "0 1 2 3 4 5 6 7 8 9 10 11", "3.14159265358979"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [*(f"Call {p}. Then wait." for p in PHONES), *OTHERS, "Call +1 (415) 555-2671 or +1 415 555 2671.", "ask +49 30 1234567 20245 times"]
    return [r.text for r in pii.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "key").orderBy("doc_id").collect()]


@pytest.mark.parametrize("i, phone", list(enumerate(PHONES)))
def test_phone_is_replaced_in_its_own_notation(found, i, phone):
    new = found[i].removeprefix("Call ").removesuffix(". Then wait.")
    assert new != phone and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", phone)


def test_other_numbers_stay(found):
    assert found[len(PHONES) : len(PHONES) + len(OTHERS)] == OTHERS


def test_a_number_has_one_surrogate_in_any_notation(found):
    digits = {re.sub("[^0-9]", "", x) for x in re.findall(r"\+[0-9() -]+[0-9]", found[-2])} | {re.sub("[^0-9]", "", found[0])}
    assert len(digits) == 1 and next(iter(digits)).startswith("1")


def test_digits_behind_a_number_hide_nothing(found):
    assert "1234567" not in found[-1]

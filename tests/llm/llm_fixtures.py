"""Helpers and fixtures of the tests in this folder; each test module names it in
``pytest_plugins`` (a conftest here would hide the one of the library's tests)."""

import random

import pytest

SMALL = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def shipped(spark):
    from seqtok.session import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def small_docs(shipped):
    return shipped.read.parquet(f"{SMALL}/documents.parquet").cache()

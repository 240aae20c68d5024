import os

import pytest

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="session")
def vocabulary():
    if not os.path.exists(VOCABULARY):
        pytest.skip("the public tokenizers aren't here")
    return VOCABULARY


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")

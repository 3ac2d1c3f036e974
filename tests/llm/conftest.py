import pytest

from tests.conftest import SMALL
from tests.llm.odd import odd


@pytest.fixture(scope="module")
def odd_docs(spark):
    return odd(spark)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r.doc_id, r.text or "") for r in small.select("doc_id", "text").collect()]

import pytest
from tables import corpus, frame


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows, True).repartition(5)


@pytest.fixture(scope="session")
def unique(rows):
    """Rows of distinct, known ids."""
    seen, out = set(), []
    for i, t in rows:
        if i is not None and i not in seen:
            seen.add(i)
            out.append((i, t))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [], True)

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    return build_session("tests", 8, **{"spark__checkpoint__dir": str(shared)})


@pytest.fixture
def sf_dir():
    return SMALL


def rows(df, *columns, order=None):
    """Sorted tuples of a small result."""
    columns = columns or df.columns
    out = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(out, key=order or (lambda t: tuple((x is not None, str(x)) for x in t)))


@pytest.fixture
def docs5(spark):
    texts = [
        "first leaflet on kettles",
        "second note on lanterns",
        "third page on bridges",
        "fourth card on violins",
        "fifth sheet on orchards",
    ]
    return make_store(spark, texts)


def make_store(spark, texts):
    """Store rows with offline vectors, one chunk per text."""
    from millrace.operators.embed import embed_mock

    data = [(f"c{i}", f"/docs/{i}.txt", 0, t, '{"path":"/docs/%d.txt","idx":"%d"}' % (i, i)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "chunk_id string, doc_key string, pos int, text string, metadata_json string")
    return embed_mock(df)


def make_queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten " * 400
#: Nulls in every column, empty, blank and very long texts, ties, repeated rows.
ODD = [
    (1, "", None, None, None),
    (2, None, "en", "a", 0),
    (None, "a null id, 4111 1111 1111 1111", "en", "a", 5),
    (3, LONG, "en", "a", len(LONG)),
    (3, LONG, "en", "a", len(LONG)),
    (4, " \n\t ", "en", "b", 4),
    (5, "  two  blanks ▁ and a mark▁▁x \x00 é\U0001f600 <s> </s> <|endoftext|> İ ﬀ", "en", "b", 9),
    (6, "Mail x.y@z.org, call +49 (0) 30 123456, ip 1.2.3.4 or 1.2.3.999", "en", "b", 9),
    (7, "x" * 5000, "en", "b", 5000),
    (None, None, None, None, None),
]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd_docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    plain = "ids decoded n_tokens id th pos words h h1 h2 n u gone f0 f1 statistics score predicted base more spans rate posterior copies kind key payload crc start host path rule verdict removed_lines label domain y rep rep_h at_id at_th runs kept at_host at_path best salt node root buckets url_host"
    own = "_th _h _n _u _gone _gone_id _gone_th _kept _host _path _rule _verdict _id _kh _rh _key _text _domain _y _salt __u __h __n __th"
    return odd_docs.select("*", *(F.lit(f"clash {n}").alias(n) for n in f"{plain} {own}".split()))


def untouched(done, columns):
    """Whether the extra columns of ``clashing`` that are left hold what they held."""
    rows = done.collect()
    return rows and all(r[c] == f"clash {c}" for r in rows for c in columns)

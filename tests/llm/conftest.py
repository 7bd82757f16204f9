import pytest

NASTY = [
    (0, "plain words here", "en", "a", 16),
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, "   \n\t ", "de", "b", 6),
    (4, "plain words here", "en", "a", 16),
    (5, "Plain  WORDS\there", "en", None, 17),
    (6, "one", "fr", "b", 3),
    (7, "été naïve 😀 größe 漢字 text", "fr", "a", 20),
    (8, "x " * 40_000 + "mail bob.smith@mail.example.com now", "en", "a", 80_034),
    (9, "a" * 30_000 + " 4111 1111 1111 1111 +1 (743) 555-3824 10.0.0.256 1.2.3.4", "en", "c", 30_060),
    (10, "1.2.3.4.5.6.7.8 a@b.c_d@e.f x@y..z@w.v 1234567890123456789012345", "en", "c", 60),
    (11, "+12 34 56 78 90.+49 (0)30-1234-567 ++1 555 0100 99 ", "en", "c", 50),
    (12, "card 4111-1111-1111-1111, 4111111111111112 5500005555555559.", "en", "c", 60),
    (12, "card 4111-1111-1111-1111, 4111111111111112 5500005555555559.", "en", "c", 60),
    (13, "Dr. Jane Roe (212) 555-0100 call 078-05-1120 jane [at] site [dot] org", "en", "c", 60),
    (14, "é@x.com 😀a@b.co.uk\x0b1.1.1.1\x0c00255.0.0.001", "en", "c", 60),
    (None, "lost id text with a@b.com", "en", "a", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(NASTY, SCHEMA)


@pytest.fixture(scope="session")
def nasty_rows():
    return NASTY


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

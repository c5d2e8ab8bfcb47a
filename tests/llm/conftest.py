import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, size double, value string, key string, shard string, part int, fp long"


def texts():
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, item = prose(60), "One two three four five six seven eight nine ten eleven twelve."
    out = [prose(rng.randint(5, 120)) for _ in range(30)]
    out += [out[0], out[1] + " extra", out[2][:-3] + "xyz", out[3]]
    out += [prose(20) + " " + shared + " " + prose(k) for k in (3, 9, 14)]
    out += [prose(9) + "\n" + item + "\n" + prose(4), item.upper(), "short item", "prefix short item suffix"]
    out += ["", None, " \t\n", "a", "é" * 60, "é" * 61 + "ü", "=" * 300, "=" * 120 + "x" + "=" * 200, "\x00" * 70, "\x00" * 75 + "z"]
    out += ["mail a.b@c.example.com@d.org or x@y.z_q@e.f, call +1 (555) 010-2030 9 now", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, ip 10.0.0.256 1.2.3.4.5.6.7.8 001.02.3.255"]
    out += ["iban GB82 WEST 1234 5698 7654 32 account, ssn 078-05-1120 here", "1 2 3 4 5 6 7 8 9 " * 400, "z" * 30000 + "@" + "y" * 30000, "日本語 テキスト a@b.co 😀 1.1.1.1"]
    out += [prose(4000) + " " + shared, "Line one is quite long and is here shared by more than one document, surely\nthen " + prose(9)]
    out += ["Line one is quite long and is here shared by more than one document, surely\n" + prose(12), out[0], out[0]]
    return out


def rows():
    found = [(i * 3, t, "en" if i % 3 else None, ["s1", "s2", None, "ß"][i % 4], len(t or ""), i, 1.0, "v", "k", "s", 1, 2) for i, t in enumerate(texts())]
    found.append((None, texts()[4], None, None, None, None, None, None, None, None, None, None))
    found.append(found[3])
    found.append(found[3])
    return found


@pytest.fixture(scope="session")
def small_rows():
    return rows()


@pytest.fixture(scope="session")
def small_docs(spark, small_rows):
    return spark.createDataFrame(small_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_benchmark(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "short item"), (3, None), (10, "two three four five six seven eight nine ten eleven"), (2, "short item"), (4, "...")]
    return spark.createDataFrame(items, "item_id long, text string")

import re

import pytest

from voxelbase.llm import pii as P

ROWS = [
    (1, "Mail Ann.Lee7@Corp.example.com or ann.lee7@corp.example.com now."),
    (2, "call +1 (017) 555-7713, again +1-017-555-7713; card 4111 1111 1111 1111 and 1234567890123456"),
    (3, "hosts 192.168.3.4, 10.9.8.7 and 45.6.7.8! token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
    (4, "Mr. John Smith met Mrs. Jane Doe, MR. X; Господин Иван Петров и г-жа Ольга Крылова. Mr. John Smith left."),
    (5, None), (6, ""), (7, "Version 2.0 of 2024, 12 of 13"), (7, "Version 2.0 of 2024, 12 of 13"), (None, "ssn 123-45-6789 x@y.org"),
    (8, "ANN.LEE7@CORP.EXAMPLE.COM" + " z" * 30_000 + " 45.6.7.8"),
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "doc_id as kind", "'x' as canon")
    return {i: r for i, r in enumerate(sorted(P.replace_entities(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id)))}


def test_formats_and_coreference(out):
    a, b, c, d = (out[i].text for i in range(4))
    one, two = re.findall(r"\S+@\S+", a)
    assert one.lower() == two and "ann.lee7" not in a.lower() and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\.[a-z]{7}\.com", one)
    p, q = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", b), re.findall(r"\+1-(\d{3})-(\d{3})-(\d{4})", b)
    assert p == q and p != [("017", "555", "7713")]
    valid = lambda s: sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(s))) % 10
    cards = re.findall(r"card ((?:\d{4} ?){4})and (\d{16})", b)[0]
    assert valid(cards[0].replace(" ", "")) == 0 and cards[0] != "4111 1111 1111 1111 " and valid(cards[1]) == valid("1234567890123456")
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", c)
    assert ips[0].startswith("192.168.") and ips[1].startswith("10.") and len(set(ips)) == 3 and not {"192.168.3.4", "10.9.8.7", "45.6.7.8"} & set(ips)
    assert re.search(r'token = "[0-9a-f]{40}"', c) and "04dbebab" not in c
    assert not re.search("Smith|Doe|Иван|Ольга", d)
    m = re.findall(r"Mr\. (\w+ \w+)", d)
    assert m[0] == m[1] and m[0].split()[0] in P.NAMES["man", "latin"] and re.search(r"Mrs\. (\w+)", d)[1] in P.NAMES["woman", "latin"]
    assert re.search(r"Господин (\w+)", d)[1] in P.NAMES["man", "cyrillic"] and re.search(r"г-жа (\w+)", d)[1] in P.NAMES["woman", "cyrillic"]
    assert d.split("Mr.")[0] == "" and d.endswith(" left.")
    long = next(r for r in out.values() if r.doc_id == 8).text
    assert long.split()[0] == two.upper() and long.split()[-1] == ips[2]


def test_rest_is_untouched(out):
    assert len(out) == len(ROWS)
    same = {(r.doc_id, r.text, r.n_replaced) for r in out.values() if r.doc_id in (5, 6, 7)}
    assert same == {(5, None, 0), (6, "", 0), (7, ROWS[6][1], 0)}
    assert all(r.kind == r.doc_id and r.canon == "x" for r in out.values())
    assert [r.n_replaced for r in out.values() if r.doc_id is None] == [2]


def test_surrogates_are_one_to_one(spark):
    rows = [("ip", f"10.0.{a}.{b}") for a in range(20) for b in range(100)] + [("ssn", f"{i:09d}") for i in range(3000)] + [("man", f"{chr(97 + i % 26)}{i}") for i in range(500)]
    table = P.draw_surrogates(spark.createDataFrame(rows, "kind string, canon string")).toPandas()
    assert len(table) == len(rows) and not table.duplicated(["kind", "stand_in"]).any()
    assert not set(zip(table.kind, table.stand_in, strict=True)) & set(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = P.replace_entities(docs).collect()
    assert len(rows) == len(before) and sum(r.n_replaced for r in rows) > 50
    for r in rows:
        old = re.findall(r"\d{16}|\S+@mail\d\.example\.com|\d+\.\d+\.\d+\.\d+|[0-9a-f]{40}|555-\d{4}", before[r.doc_id])
        assert not [x for x in old if x in r.text], (r.doc_id, old)
    assert P.replace_entities(docs.limit(0)).count() == 0


def test_full_address_space_ends(spark, monkeypatch):
    """All 65,536 addresses of a private range: each gets another one of them, one to one."""
    monkeypatch.setattr(P, "ROUNDS", 2)
    rows = spark.range(1 << 16).selectExpr("'ip' AS kind", "concat('192.168.', id div 256, '.', id % 256) AS canon")
    table = P.draw_surrogates(rows).toPandas()
    assert len(table) == 1 << 16 and set(table.stand_in) == set(table.canon) and not (table.stand_in == table.canon).any()


def test_addresses_keep_their_range(spark):
    import ipaddress
    import random

    rng = random.Random(5)
    nets = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]
    addresses = {str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(3000)} | {str(n[k]) for n in nets for k in (0, 1, 77, -1)} | {"9.255.255.255", "11.0.0.0", "172.15.255.255", "172.32.0.0", "192.167.255.255", "192.169.0.0", "255.255.255.255"}
    table = P.candidates(spark.createDataFrame([("ip", a) for a in addresses], "kind string, canon string"), "k", 0).toPandas()
    place = lambda a: next((i for i, n in enumerate(nets) if ipaddress.ip_address(a) in n), None)
    assert table.stand_in.is_unique and all(place(a) == place(b) for a, b in zip(table.canon, table.stand_in, strict=True))


def test_permutations_are_one_to_one_in_small_spaces(spark):
    """Every two-sign local part of one domain, every vowel and consonant pair of a name: images stay in the space."""
    from itertools import product

    rows = [("email", f"{a}{b}@x.org") for a, b in product("abcdefghijklmnopqrstuvwxyz", "0123456789")] + [("man", a + b) for a, b in product("bcdfghjklmnpqrstvwxyz", "aeiou")] + [("ssn", f"{i:03d}") for i in range(1000)]
    table = P.candidates(spark.createDataFrame(rows, "kind string, canon string"), "k", 0).toPandas()
    for kind in ("man", "ssn"):
        own = table[table.kind == kind]
        assert set(own.stand_in) == set(own.canon)
    mail = table[table.kind == "email"].stand_in
    assert mail.is_unique and len({m.split("@")[1] for m in mail}) == 1 and all(re.fullmatch(r"[a-z]\d@[a-z]\.org", m) for m in mail)


def test_whole_ipv6_and_padded_addresses(spark):
    df = spark.createDataFrame([(1, "at 2001:db8:0:0:0:0:2:1 and 2001:DB8:0:0:0:0:2:1, not 12:34:56"), (2, "10.01.2.3 is 10.1.2.3")], "doc_id long, text string")
    a, b = (r.text for r in P.replace_entities(df).orderBy("doc_id").collect())
    one, two = re.findall(r"(?:\w+:){7}\w+", a)
    assert one == two.lower() and one != "2001:db8:0:0:0:0:2:1" and a.endswith("not 12:34:56")
    x, y = re.findall(r"\d+\.\d+\.\d+\.\d+", b)
    assert x == y and x.startswith("10.")

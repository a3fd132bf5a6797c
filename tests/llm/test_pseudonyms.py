import datetime
import re

from changelens.llm import catalog, pseudonyms
from changelens.llm.pseudonyms import Feistel, Pseudonyms, luhn
from tests.llm.conftest import SF

NAMES = Pseudonyms(Feistel(b"k"))


def test_permutations_and_their_inverse():
    f = Feistel(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        got = [f.permute("x", n, i) for i in range(n)]
        assert sorted(got) == list(range(n))
        assert [f.permute("x", n, i, back=True) for i in got] == list(range(n))
    even = lambda x: x % 2 == 0
    assert sorted(f.permute("x", 100, i, even) for i in range(0, 100, 2)) == list(range(0, 100, 2))
    assert [f.permute("x", 1000, i) for i in range(9)] != [Feistel(b"l").permute("x", 1000, i) for i in range(9)]


def test_formats_are_kept_and_valid():
    text = 'Mail a.B-7@x.example.com, ip 10.0.0.255, tel +49 30 1234567 or (212) 555-1234, card 4111 1111 1111 1111, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, on 2024-02-29 and 3.4.2021, token = "%s".' % ("0a" * 20)
    got, found = NAMES.replace(text)
    assert [k for k, _, _ in found] == ["email", "ip", "phone", "phone", "card", "ssn", "iban", "date", "date", "secret"]
    assert len(got.split()) == len(text.split()) and NAMES.replace(text) == (got, found)
    card = re.search(r"card ((?:\d{4} ){3}\d{4})", got).group(1)
    assert luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    assert pseudonyms._iban_rest(re.search(r"DE[\d ]+\d", got).group().replace(" ", "")) == 1
    datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", got).group())
    assert re.search(r"\+49 \d\d \d{7}\b", got) and "@x.example.com" in got
    for kind, a, b in found:
        assert text[a:b] not in got or kind == "date"


def test_values_that_are_not_valid_stay():
    for text in ("4111 1111 1111 1112", "999.1.1.1", "2023-02-29", "32.1.2020", "000-12-3456", "DE00 3704 0044 0532 0130 00", "version 3.", "4.0.1", "1234", "f" * 40, "0000000000000000", "", "no digits"):
        assert NAMES.replace(text) == (text, [])


def test_equal_values_are_linked_and_different_ones_are_not():
    ips = [f"10.1.{i}.{j}" for i in range(20) for j in range(20)]
    assert len({NAMES.of("ip", ip) for ip in ips}) == 400
    assert NAMES.replace("x 10.1.2.3 y")[0][2:-2] == NAMES.replace("10.1.2.3")[0]


def test_query(spark, documents):
    names = Pseudonyms(Feistel(catalog.KEY))
    want = sorted((r["doc_id"], *names.replace(r["text"])) for r in documents)
    got = sorted((r["doc_id"], r["text"], [tuple(f) for f in r["found"]]) for r in catalog.op10_pseudonyms(spark, SF).collect())
    assert got == want and any(f for _, _, f in got)


def test_odd_rows(spark, odd, empty):
    got = pseudonyms.pseudonymize(odd.withColumnRenamed("size", "found"), b"k")
    rows = got.collect()
    assert len(rows) == odd.count() and [r["found"] for r in rows if r["text"] is None] == [[], []]
    assert pseudonyms.pseudonymize(empty, b"k", found_col=None).columns == odd.columns


def test_values_beside_other_digits_and_words():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    new_card, new_iban = NAMES.of("card", card), NAMES.of("iban", iban)
    tight = lambda v: v.replace(" ", "")
    for text in (f"{card} 12/27", f"{card} 123", f"paid 2 {card}", f"{card}-123", f"123 456 {card}", f"+49 {card} 12", f"{tight(card)} 12/27", f"7 {tight(card)} 12"):
        assert NAMES.replace(text)[0] == text.replace(card, new_card).replace(tight(card), tight(new_card))
    for text in (f"{iban} BANK", f"{tight(iban)} BIC", f"{iban} BANKER AND", f"XY00 {iban}"):
        assert NAMES.replace(text)[0] == text.replace(iban, new_iban).replace(tight(iban), tight(new_iban))
    dashed = card.replace(" ", "-")
    assert NAMES.replace(f"2-{dashed}-5500-0000-0000-0004-1")[0] == f"2-{new_card.replace(' ', '-')}-{NAMES.of('card', '5500-0000-0000-0004')}-1"
    got, found = NAMES.replace(f"2024-01-05 {card} 12 or 123-45-6789 {card}")
    assert [k for k, _, _ in found] == ["date", "card", "ssn", "card"] and got.count(new_card) == 2
    many = f"{card} " * 20000
    assert NAMES.replace(many)[0] == f"{new_card} " * 20000
    for text in ("1 " * 20000, "7" * 20000, "AB12 " * 5000):
        assert len(NAMES.replace(text)[0]) == len(text)


def test_dates_in_every_order_phones_with_other_signs_and_upper_case_keys():
    shapes = {"date": ("12/31/1999", "2024/01/05", "2024/1/5", "3/4/2021", "31.12.1999", "12.31.1999"),
              "phone": ("212.555.0123", "212 555 0123", "212-555-0123", "(212) 555 0123", "(212) 555.0123"), "secret": ("0A" * 20, "0a" * 20)}
    for kind, values in shapes.items():
        lead = "token = " if kind == "secret" else "on "
        for value in values:
            got, found = NAMES.replace(f"{lead}{value}, then")
            assert found == [(kind, len(lead), len(lead) + len(value))] and value not in got
            assert NAMES.replace(got)[1][0][0] == kind
    assert re.fullmatch(r"token = [0-9A-F]{40}", NAMES.replace("token = " + "0A" * 20)[0])
    assert NAMES.replace("key: " + "0A" * 20)[0].lower() == NAMES.replace("key: " + "0a" * 20)[0]
    assert len({re.sub(r"[ .-]", "", NAMES.replace(v)[0]) for v in ("212.555.0123", "212 555 0123", "212-555-0123")}) == 1
    # a date read month first becomes one that can only be read so, and no two become one
    firsts = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(365)]
    months = [f"{d:%m/%d/%Y}" for d in firsts if d.day > 12]
    new = [NAMES.of("date", m) for m in months]
    assert len(set(new)) == len(months) and all(int(n.split("/")[1]) > 12 and datetime.datetime.strptime(n, "%m/%d/%Y") for n in new)
    assert not set(new) & {NAMES.of("date", f"{d:%d/%m/%Y}") for d in firsts}
    for text in ("13/32/1999", "2024/13/05", "2023/02/29", "0A" * 20):
        assert NAMES.replace(text) == (text, [])

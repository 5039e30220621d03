from fieldtrust.functions import normalize as n


def test_strings(values):
    got = values(n.normalize_string, ["ABC Corp", "ACME   Industries", "  a\t b\n", "É É", "", None])
    assert got == ["abc corp", "acme industries", "a b", "é é", "", None]


def test_addresses(values):
    got = values(n.normalize_address, ["12, Main St.\nMumbai", "12 Main St, Mumbai", "a_b-c é", "", None])
    assert got == ["12 main st mumbai", "12 main st mumbai", "a_b c é", "", None]


def test_numbers(values):
    got = values(n.normalize_number, ["1,234.56", "INR 500", "N/A", "(12)", "1.2.3", "", "-5", None, "."])
    assert got == [1234.56, 500.0, None, 12.0, None, None, -5.0, None, None]


def test_dates(values):
    cases = {
        "2024-03-15": "2024-03-15", "15/03/2024": "2024-03-15", "15-03-2024": "2024-03-15",
        "03/25/2024": "2024-03-25", "15.03.2024": "2024-03-15", "March 15, 2024": "2024-03-15",
        "15 march 2024": "2024-03-15", "  2024-3-5 ": "2024-03-05", "02/03/2024": "2024-03-02",
        # No form fits: the stripped input comes back.
        "2024-02-30": "2024-02-30", " 03-25-2024 ": "03-25-2024", "Foo 1, 2024": "Foo 1, 2024",
        "2024": "2024", "2024-03": "2024-03", "next week": "next week", "30/02/2024": "30/02/2024",
        "Mar 15, 2024": "Mar 15, 2024", "2024-march-15": "2024-march-15", "15/03-2024": "15/03-2024", "": "",
    }
    assert values(n.normalize_date, list(cases)) == list(cases.values())
    assert values(n.normalize_date, [None]) == [None]

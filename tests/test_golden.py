"""Hand-calculated product analytics fixtures."""

from datetime import date, datetime, timedelta

import pytest

from tidemark import schemas
from tidemark.operators import explorer, funnel, reports, retention
from tidemark.operators.filters import EventFilter


def T(text):
    return datetime.fromisoformat(text)


def event_rows(project, rows):
    """(id, type, user, anonymous, session, occurred, received, properties)"""
    return [(project, i, t, 1, u, a, s, T(o), T(r or o), p) for i, t, u, a, s, o, r, p in rows]


@pytest.fixture(scope="module")
def golden(spark):
    d10, d11 = "2026-09-10", "2026-09-11"

    def money(n):
        return f'{{"amountMinor":"{n}","currency":"USD"}}'

    rows = [
        ("e1", "signup", "user-1", None, "sess-1", f"{d10} 10:00:00", None, "{}"),
        ("e2", "view_item", "user-1", None, "sess-1", f"{d10} 10:05:00", None, "{}"),
        ("e3", "purchase", "user-1", None, "sess-1", f"{d10} 10:10:00", None, money(5000)),
        ("e4", "signup", "user-2", None, "sess-2", f"{d10} 23:59:59", None, "{}"),
        ("e5", "view_item", "user-2", None, "sess-3", f"{d11} 00:00:00", None, "{}"),
        ("e6", "signup", "user-3", None, "sess-4", f"{d10} 10:00:00", None, "{}"),
        ("e7", "purchase", "user-3", None, "sess-4", f"{d10} 12:00:00", None, money(3000)),
        ("e8", "refund", "user-3", None, "sess-5", f"{d11} 12:00:00", None, money(1000)),
        ("e9", "view_item", None, None, "sess-anon", f"{d10} 10:00:00", None, "{}"),
    ]
    return spark.createDataFrame(event_rows("fixture_project", rows), schemas.EVENTS)


START, END = datetime(2026, 9, 10), datetime(2026, 9, 12)


def test_funnel(golden):
    steps = ["signup", "view_item", "purchase"]
    found = funnel.funnel(golden, steps, START, END, timedelta(days=2), "fixture_project").collect()
    assert [(r.step, r.event_type, r.users) for r in found] == [(1, "signup", 3), (2, "view_item", 2), (3, "purchase", 1)]


def test_funnel_without_events_keeps_steps(golden):
    found = funnel.funnel(golden, ["signup", "login"], START, END, timedelta(days=2), "nobody").collect()
    assert [(r.step, r.users) for r in found] == [(1, 0), (2, 0)]


def test_retention(golden):
    found = retention.retention(golden, date(2026, 9, 10), date(2026, 9, 12), "signup", "view_item", END).collect()
    assert [(str(r.cohort_date), r.day, r.cohort_users, r.returned_users, r.complete) for r in found] == [
        ("2026-09-10", 0, 3, 1, True),
        ("2026-09-10", 1, 3, 1, True),
    ]


def test_retention_today_is_incomplete(golden):
    now = datetime(2026, 9, 10, 23)
    found = retention.retention(golden, date(2026, 9, 10), date(2026, 9, 11), "signup", "view_item", now).collect()
    assert not any(r.complete for r in found)


def test_revenue(golden):
    (row,) = reports.revenue(golden, START, END).collect()
    assert (row.currency, row.gross_minor, row.refund_minor, row.net_minor, row.purchases, row.refunds) == (
        "USD", 8000, 1000, 7000, 2, 1,
    )


def test_revenue_exclusions(spark):
    docs = [
        '{"amountMinor":50.5,"currency":"A"}', '{"amountMinor":5,"currency":null}', '{"amountMinor":true,"currency":"A"}',
        '{"amountMinor":5}', '{"amountMinor":"5\\n","currency":"A"}', '{"amountMinor":-7,"currency":"A"}', "{}",
    ]
    rows = [(f"e{i}", "purchase", "u", None, "s", "2026-09-10 10:00:00", None, d) for i, d in enumerate(docs)]
    events = spark.createDataFrame(event_rows("p", rows), schemas.EVENTS)
    (row,) = reports.revenue(events, START, END).collect()
    assert (row.currency, row.gross_minor, row.purchases) == ("A", -7, 1)


def test_sessions(golden):
    found = reports.sessions(golden, START, END).collect()
    assert len(found) == 6
    first = next(r for r in found if r.session_id == "sess-1")
    assert (first.user_id, first.events) == ("user-1", 3)


def test_edge_fixture(spark):
    ten = "2026-09-10 10:00:00"
    rows = [
        ("dup", "signup", "dup-user", None, "sess-dup", ten, None, "{}"),
        ("00000000-0000-0000-0000-000000000002", "view_item", "tie-user", None, "sess-tie", ten, None, "{}"),
        ("00000000-0000-0000-0000-000000000001", "view_item", "tie-user", None, "sess-tie", ten, None, "{}"),
        ("late", "signup", "late-user", None, "sess-late", "2026-09-09 23:59:00", "2026-09-11 09:00:00", "{}"),
        ("anon", "signup", None, "anon-1", "sess-anon", ten, None, "{}"),
    ]
    events = spark.createDataFrame(event_rows("edge_fixture", rows), schemas.EVENTS)
    page, cursor = explorer.timeline_page(events, EventFilter("edge_fixture", user_id="tie-user"), 50)
    assert [r.event_id[-1] for r in page] == ["1", "2"] and cursor is None
    late = reports.time_series(events, EventFilter(end=datetime(2026, 9, 10)), "day").collect()
    assert [(str(r.bucket), r.events) for r in late] == [("2026-09-09 00:00:00", 1)]
    (users,) = reports.active_users(events).collect()
    assert (users.identified_users, users.anonymous_users) == (3, 1)


@pytest.fixture(scope="module")
def delivered(spark):
    doc = '{"amountMinor":4999,"country":"VN","nothing":null}'
    rows = [
        ("e1", "page_view", "user-1", None, "session-1", "2026-09-10 00:00:00", None, doc),
        ("e2", "login", "user-1", None, "session-1", "2026-09-10 00:00:00", None, doc),
        ("e3", "purchase", "user-1", None, "session-1", "2026-09-10 01:00:00", None, doc),
        ("e4", "page_view", "user-2", None, "session-1", "2026-09-11 00:00:00", None, doc),
        ("e5", "page_view", None, "anon-1", "session-1", "2026-09-10 00:00:00", None, doc),
    ]
    return spark.createDataFrame(event_rows("a", rows), schemas.EVENTS)


DAY = EventFilter("a", datetime(2026, 9, 10), datetime(2026, 9, 11))


def test_half_open_window(delivered):
    summary = {r.event_type: r.events for r in reports.event_summary(delivered, DAY).collect()}
    assert summary == {"page_view": 2, "login": 1, "purchase": 1}
    hourly = reports.time_series(delivered, DAY, "hour").collect()
    assert sum(r.events for r in hourly) == 4
    assert sum(r.events for r in hourly if r.bucket == datetime(2026, 9, 10)) == 3
    (users,) = reports.active_users(delivered, DAY).collect()
    assert (users.identified_users, users.anonymous_users) == (1, 1)


@pytest.mark.parametrize(
    "name,value,rows",
    [
        ("country", '"VN"', 5), ("country", '"vn"', 0), ("amountMinor", "4999.00", 5), ("amountMinor", "4.999e3", 5),
        ("amountMinor", '"4999"', 0), ("nothing", "null", 5), ("missing", "null", 0), ("x' OR 1=1 --", '"VN"', 0),
        ("country", '"V\\"N"', 0), ("amountMinor", "499", 0),
    ],
)
def test_property_filter(delivered, name, value, rows):
    scope = EventFilter("a", property_name=name, property_value=value)
    assert scope.apply(delivered).count() == rows


def test_filter_errors():
    far = EventFilter("a", datetime(2026, 9, 2), datetime(2026, 9, 1), " ", "u" * 201, "k", None)
    assert set(far.errors()) == {"from", "eventType", "userId", "propertyName"}
    assert "propertyValue" in EventFilter("a", property_name="k", property_value="[1]").errors()
    assert "propertyValue" in EventFilter("a", property_name="k", property_value="1.00000000000000000000000000001").errors()
    with pytest.raises(ValueError):
        EventFilter("a", datetime(2026, 1, 1), datetime(2026, 3, 1)).check(window_required=True)


def test_paging(delivered):
    scope, cursor, seen = EventFilter("a", user_id="user-1"), None, []
    for _ in range(3):
        page, cursor = explorer.timeline_page(delivered, scope, 1, cursor)
        seen += [(r.event_id, r.event_type) for r in page]
    assert cursor is None and len({i for i, _ in seen}) == 3 and seen[-1][1] == "purchase"
    _, cursor = explorer.timeline_page(delivered, scope, 1)
    for other in (EventFilter("a", user_id="user-2"), EventFilter("b", user_id="user-1")):
        with pytest.raises(ValueError):
            explorer.timeline_page(delivered, other, 1, cursor)
    assert explorer.timeline_page(delivered, EventFilter("b"), 10) == ([], None)

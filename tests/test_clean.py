import pytest

from nimbora.operators.clean import clean_daily, unreadable_readings


def by_day(df):
    return {str(r.date): r for r in df.collect()}


def test_missing_kinds(records, make):
    rows = [
        make.raw("2024-01-01", tmed="10,0"),
        make.raw("2024-01-02"),
        make.raw("2024-01-03", tmed=None),
        make.raw("2024-01-04", tmed=""),
        make.raw("2024-01-05", tmed="0"),
    ]
    clean = by_day(clean_daily(records(rows)))
    # Absent takes the mean of the four known values; null, '' and '0' are zero.
    assert [clean[f"2024-01-0{d}"].average_temperature for d in range(1, 6)] == [10, 2.5, 0, 0, 0]


def test_codes_feed_the_mean_and_nothing_known_gives_zero(records, make):
    rows = [make.raw("2024-01-01", prec="Ip"), make.raw("2024-01-02", prec="Acum"), make.raw("2024-01-03")]
    clean = by_day(clean_daily(records(rows)))
    assert clean["2024-01-03"].precipitation == pytest.approx(0.025)
    assert clean["2024-01-01"].sunshine == 0.0 and clean["2024-01-01"].wind_direction == 0


def test_wind_is_filled_with_the_truncated_mean_sector(records, make):
    texts = ["35", "99", "88", None, "36", "0", "9"]
    rows = [make.raw(f"2024-01-0{i}", dir=t) for i, t in enumerate(texts, start=1)]
    clean = by_day(clean_daily(records(rows)))
    assert [clean[d].wind_direction for d in sorted(clean)] == [7, 2, 2, 2, 0, 0, 2]


def test_means_are_per_station_and_per_loaded_range(records, make):
    rows = [
        make.raw("2024-01-01", tmed="10,0"),
        make.raw("2025-01-01", tmed="20,0"),
        make.raw("2025-01-02"),
        {**make.raw("2025-01-02"), "indicativo": "B"},
    ]
    full = {(r.idema, str(r.date)): r.average_temperature for r in clean_daily(records(rows)).collect()}
    part = {(r.idema, str(r.date)): r.average_temperature for r in clean_daily(records(rows[1:])).collect()}
    assert full["1082", "2025-01-02"] == 15 and full["B", "2025-01-02"] == 0
    assert part["1082", "2025-01-02"] == 20


def test_unreadable_text_raises_or_is_quarantined(records, make):
    rows = [
        make.raw("2024-01-01", tmed="10,0"),
        make.raw("2024-01-02", tmed="warm"),
        make.raw("2024-13-01", tmed="1,0"),
    ]
    with pytest.raises(Exception, match="unreadable reading"):
        clean_daily(records(rows)).collect()
    clean = by_day(clean_daily(records(rows), strict=False))
    assert clean["2024-01-02"].average_temperature == 10 and len(clean) == 2
    bad = {(r.field, r.text) for r in unreadable_readings(records(rows)).collect()}
    assert bad == {("tmed", "warm"), ("fecha", "2024-13-01")}


def test_row_index_and_column_choice(records, make):
    rows = make.daily("2019-12-30", 5)
    found = clean_daily(records(rows), row_index=True, columns=["precipitation"])
    assert found.columns == ["idema", "date", "precipitation", "row_index"]
    assert [r.row_index for r in found.orderBy("date").collect()] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="unknown clean columns"):
        clean_daily(records(rows), columns=["rain"])

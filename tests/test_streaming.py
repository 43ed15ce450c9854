from amalgam.streaming import collect_records, current_profiles, file_stream


def test_files_that_arrive_join_earlier_ones(spark, tmp_path):
    inbox, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    (tmp_path / "in").mkdir()
    for name, text in (("a.csv", "name,email\nAda Lovelace,ada@x.io\n"), ("b.txt", "Spoke with ada; mail ADA@x.io, 12 years")):
        (tmp_path / "in" / name).write_text(text)
        collect_records(file_stream(spark, inbox), table, mark).awaitTermination()
    (row,) = current_profiles(spark, table).collect()
    assert row.full_name == "Ada Lovelace" and row.years_experience == 12 and row.field_confidence["emails"] == 0.932

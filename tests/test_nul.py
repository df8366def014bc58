from utterlake.operators.compact import csv_records


def test_only_records_with_a_nul_are_lost():
    text = 'utt_id,form\nu1,a\nu2,"b\0"\nu3,c\nu4,d'
    assert [u for u, _ in csv_records(text + "\0" * 50)] == ["u1", "u3"]
    assert [u for u, _ in csv_records(text + "\n" + "\0" * 50)] == ["u1", "u3", "u4"]

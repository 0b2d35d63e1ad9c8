import pytest
from pyspark.sql import functions as F

from tallyleaf.operators import ocr_output

OUTPUTS = {
    "lists": '{"rec_texts":["a"," b ","","c"],"rec_scores":[0.5,"x",1,88],"rec_polys":[[[1,2],[3,2],[3,4],[1,4]],[9,8,7,6]],"dt_polys":[]}',
    "fewer scores": '{"texts":["a","b"],"scores":[1]}',
    "empty first key": '{"rec_texts":[],"texts":["t"],"rec_scores":null,"scores":["0.25"],"boxes":[[1,2,3]]}',
    "pages": '[{"texts":["p"],"scores":[88],"boxes":[[1,1,2,2]]},{"text":"single","score":0.75,"box":[4,3,2,1]}]',
    "items": '[[[[[1,2],[3,2],[3,4],[1,4]],["t",0.9]],[[0,0,5,5],["u"]]]]',
    "one item": '[[1,2,3,4],["solo",1]]',
    "two points": '[[[[1,2],[3,4]],["x",0.1]],null]',
    "pairs of points are no item": "[[[1,2],[3,4]]]",
    "broken box": '[["no box",["x",1]],[[[1,2],[3]],["y",1]],[[1,2,3,"z"],["w",1]]]',
    "null": None,
    "no json": "[1",
    "empty": "[]",
    "number": "5",
    "string": '"text"',
}
WANT = {
    "lists": [("a", 50.0, (1, 2, 3, 4)), ("b", 0.0, (7, 6, 9, 8)), ("c", 88.0, None)],
    "fewer scores": [("a", 100.0, None)],
    "empty first key": [("t", 25.0, None)],
    "pages": [("p", 88.0, (1, 1, 2, 2)), ("single", 75.0, (2, 1, 4, 3))],
    "items": [("t", 90.0, (1, 2, 3, 4)), ("u", 0.0, (0, 0, 5, 5))],
    "one item": [("solo", 100.0, (1, 2, 3, 4))],
    "two points": [("x", 10.0, (1, 2, 3, 4))],
    "broken box": [("x", 100.0, None), ("y", 100.0, None), ("w", 100.0, None)],
}


def read(df, column):
    got = {}
    for r in ocr_output.read_output(df, column).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.score, None if r.x1 is None else (r.x1, r.y1, r.x2, r.y2)))
    return got


def test_every_shape(spark):
    df = spark.createDataFrame(list(OUTPUTS.items()), "doc_id string, p string")
    assert read(df, "p") == WANT
    assert read(df.select("doc_id", F.try_parse_json("p").alias("v")), "v") == WANT


def test_deeper_output_is_refused(spark):
    df = spark.createDataFrame([("d", "[" * 9 + '{"text":"x"}' + "]" * 9)], "doc_id string, p string")
    with pytest.raises(Exception, match="nested deeper"):
        ocr_output.read_output(df, "p").collect()


def test_lists_of_a_page_are_made_once(spark):
    """Not again for each line, which made a page of n lines cost n times n."""
    made = ocr_output.of_dictionary(F.col("v"))._jc.toString()
    assert made.count("$.rec_texts") == made.count("$.rec_scores") == made.count("$.rec_boxes") == 1

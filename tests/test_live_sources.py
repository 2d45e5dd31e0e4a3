import json

from tickloom.sources import live


def Recorded(path):
    """Answers kept in a file, so that executors see what the test adds. The class is local, so that it is pickled whole."""

    class Client:
        def __init__(self, path):
            self.path = str(path)

        def held(self):
            with open(self.path) as f:
                return json.load(f)

        def sources(self):
            return sorted(self.held())

        def newest(self, source):
            if source == "broken":
                raise OSError("no answer")
            return max((m for m, _ in self.held()[source]), default=None)

        def fetch(self, source, after, upto):
            return [(m, p) for m, p in self.held()[source] if after < m <= upto]

    return Client(path)


def run(spark, name, checkpoint, **options):
    rows, batches = [], []

    def take(df, number):
        got = df.collect()
        rows.extend(map(tuple, got))
        batches.append(len(got))

    q = spark.readStream.format(name).options(**options).load().writeStream.foreachBatch(take).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(rows)


def test_batch_and_stream_go_on_at_the_marks(spark, tmp_path):
    path = tmp_path / "answers.json"
    answers = {"wire": [[100, "a"], [200, "b"], [90_000, "c"]], "feed": [[150, "x"]], "empty": [], "broken": [[1, "never"]]}
    path.write_text(json.dumps(answers))
    spark.dataSource.register(live.source_format("recorded", Recorded(path)))
    all_rows = sorted((s, m, p) for s, xs in answers.items() if s != "broken" for m, p in xs)
    df = spark.read.format("recorded").load()
    assert sorted(map(tuple, df.collect())) == all_rows
    # a day a task, so the wire has two
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, spark.read.format("recorded").options(since=150, sources="wire,feed").load().collect())) == [("wire", 200, "b"), ("wire", 90_000, "c")]
    assert run(spark, "recorded", tmp_path / "c") == all_rows
    # nothing new, then something new of one source, and a source that is new
    assert run(spark, "recorded", tmp_path / "c") == []
    answers["wire"].append([90_001, "d"])
    answers["late"] = [[5, "z"]]
    path.write_text(json.dumps(answers))
    assert run(spark, "recorded", tmp_path / "c") == [("late", 5, "z"), ("wire", 90_001, "d")]


def test_no_source_has_anything(spark, tmp_path):
    path = tmp_path / "none.json"
    path.write_text(json.dumps({"empty": []}))
    spark.dataSource.register(live.source_format("nothing", Recorded(path)))
    assert spark.read.format("nothing").load().count() == 0

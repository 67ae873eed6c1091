from chronoline.llm import url_filter as U


def test_hosts_paths_rules_and_vocabulary(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme/casino": ("", "", None, "block"), "http://A.Example.COM/en/1?x=/y#z": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://b.com": ("b.com", "", None, "allow"), "http://b.com/casino": ("b.com", "/casino", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"), "http://x.net/de/": ("x.net", "/de/", None, "allow"), "http://notexample.com.org/en/": ("notexample.com.org", "/en/", None, "allow"),
        "http://my-casino.org/": ("my-casino.org", "/", None, "block"), "http://casinotown.org/": ("casinotown.org", "/", None, "allow"),
        "http://cheap.org/": ("cheap.org", "/", None, "allow"), "http://cheap-pills.org/cheap": ("cheap-pills.org", "/cheap", None, "block"), "": ("", "", None, "allow"),
        "http://a.org/x://b.net/fr/": ("a.org", "/x://b.net/fr/", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, verdict string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, None)], "page_id bigint, url string")
    assert U.judge_urls(df).count() == 3 and U.judge_urls(df.limit(0)).count() == 0


def test_weights_plurals_and_a_vocabulary_file(spark, tmp_path):
    automaton = U.build_automaton(U.VOCABULARY)
    assert U.hits(automaton, "http://x.org/deal-deals") == (0, 1.0) and U.hits(automaton, "http://x.org/best-fetish") == (0, 2.0)
    assert U.hits(automaton, "http://x.org/deal/free.html?dealer") == (0, 2.0) and U.hits(automaton, "https://x.org/xxx+porn") == (2, 0)
    path = tmp_path / "terms.tsv"
    path.write_text("# list\nbad word\n\nmild\t0.75\nMilder\t0.5\n" + "".join(f"term{i}\t2\n" for i in range(5000)), encoding="utf-8")
    vocabulary = U.load_vocabulary(str(path))
    assert vocabulary.strict == {"bad word"} and len(vocabulary.soft) == 5002 and vocabulary.soft["milder"] == 0.5
    urls = ["http://a.org/mild/milder", "http://a.org/term4999", "http://a.org/mild-milds-milder-milders", "http://a.org/Bad Word"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["verdict"], r["soft_weight"]) for r in U.judge_urls(df, vocabulary=vocabulary, soft_needed=2.0).collect()}
    assert got == {0: ("allow", 1.25), 1: ("block", 2.0), 2: ("allow", 1.25), 3: ("block", 0.0)}

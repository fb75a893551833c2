import uuid

from pyspark.sql import functions as F

from placeloom.functions import ids, nested, numbers, text


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return tuple(row)


def test_uuid5_and_base57(spark):
    names = ["a", "Éts Dupont", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u")).withColumn("s", ids.base57("u")).collect()
    for r in rows:
        want = uuid.uuid5(uuid.NAMESPACE_DNS, r["n"])
        assert r["u"] == str(want)
        n = 0
        for c in r["s"]:
            n = n * 57 + ids.BASE57.index(c)
        assert n == want.int and len(r["s"]) == 22


def test_cleaners(spark):
    clean = lambda c: (c["value"], c["level"])
    L = F.lit
    assert one(spark, *clean(text.clean_siret(L("1234567890123"))), *clean(text.clean_siret(L("12")))) == ("01234567890123", None, "", "warning")
    assert one(spark, *clean(text.clean_postcode(L("1234"))), *clean(text.clean_postcode(L("abc")))) == ("01234", None, "", "warning")
    assert one(spark, *clean(text.clean_phone(L("6 12 34 56 78"), L("75001"))), *clean(text.clean_phone(L("33612345678"), L("")))) == ("0612345678", None, "0612345678", None)
    assert one(spark, *clean(text.clean_email(L(" A@B.fr"))), *clean(text.clean_email(L("x")))) == ("a@b.fr", None, "", "warning")
    assert one(spark, *clean(text.clean_url(L("example.org/a"))), *clean(text.clean_url(L("no way")))) == ("https://example.org/a", None, "", "warning")
    assert one(spark, text.first_valid_url(L(""), L("bad url"), L("a.fr"))["value"], text.first_valid_url(L("bad url"), L(None).cast("string"))["level"]) == ("https://a.fr", "warning")


def test_text_shapes(spark):
    L = F.lit
    assert one(spark, text.normalize_for_match(L("Éts de l'Œuvre 12")), text.normalize_for_match(L("a 1"))) == ("de ets oeuvre", None)
    assert one(spark, text.house_number(L("12bis rue")), text.house_number(L("rue 3"))) == ("12 b", None)
    a = text.parse_address(L("3 rue du Bac - 1234 bourg-en-bresse CEDEX 2"))
    assert one(spark, a["address"], a["postcode"], a["city"])[:2] == ("3 rue du Bac", "01234")
    assert one(spark, text.repair_url(L("noise http:/ww.a..fr/en")), text.repair_url(L("//a.fr"))) == ("http://www.a.fr/", "https://a.fr")
    assert one(spark, text.concat_unique_non_empty(L("b"), L(""), L("a"), L("b")), text.words_in_common(L("a b a"), L("cab"))) == ("a b", 3)


def test_numbers(spark):
    L = F.lit
    d = one(spark, F.round(numbers.haversine_m(L(48.8566), L(2.3522), L(48.8567), L(2.3522)), 3))[0]
    assert abs(d - 11.119) < 0.001
    assert one(spark, numbers.parse_float(L("1,5,")), numbers.parse_float(L("nan")), numbers.parse_float(L("x"))) == (1.5, None, None)
    ring = F.array(*[F.struct(L(float(x)).alias("lon"), L(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert one(spark, numbers.in_polygon(L(1.0), L(1.0), ring), numbers.in_polygon(L(5.0), L(1.0), ring)) == (True, False)


def test_opening_hours(spark):
    h = nested.opening_hours(F.lit("Mo-Tu 09:00-12:00,11:00-13:00; Su 10:00-11:00"))
    days = {d["day"]: [(i["open"], i["close"]) for i in d["intervals"]] for d in one(spark, h)[0]}
    assert days["Mo"] == days["Tu"] == [(540, 780)] and days["Su"] == [(600, 660)] and days["We"] == []
    assert one(spark, nested.opening_hours(F.lit("")))[0] is None


def test_opening_hours_forms(spark):
    def hours(rule):
        got = one(spark, nested.opening_hours(F.lit(rule)))[0]
        return {d["day"]: [(i["open"], i["close"]) for i in d["intervals"]] for d in got if d["intervals"]}

    nine, two = (540, 720), (840, 1080)
    assert hours("Mo-Fr 09:00-12:00, 14:00-18:00") == {d: [nine, two] for d in ("Mo", "Tu", "We", "Th", "Fr")}
    assert hours("Fr-Mo 09:00-12:00") == {d: [nine] for d in ("Fr", "Sa", "Su", "Mo")}
    assert hours("Mo-Su 09:00-12:00; We,Sa off; PH off; PH 14:00-18:00") == {d: [nine] for d in ("Mo", "Tu", "Th", "Fr", "Su")}
    assert hours("Mo 22:00-02:00; Su 23:00-01:00") == {"Mo": [(0, 60), (1320, 1440)], "Tu": [(0, 120)], "Su": [(1380, 1440)]}
    assert hours("Mo-Fr 09:00-12:00; Fr 14:00-18:00") == {"Mo": [nine], "Tu": [nine], "We": [nine], "Th": [nine], "Fr": [two]}
    assert hours("Mo 09:00-12:00, Tu 14:00-18:00") == {"Mo": [nine], "Tu": [two]}
    assert hours("Mo, We,PH 09:00-12:00") == {"Mo": [nine], "We": [nine]}
    assert hours("Mo sunrise-sunset; Tu closed; gibberish") == {}


def test_urls_are_mended(spark):
    """Pairs that the repair must give: noise, schemes, signs and www labels."""
    pairs = {
        "http://a.com": "http://a.com", "https://b.com": "https://b.com", "ahttps://c.com": "https://c.com", "c.com": "https://c.com", "//d.com": "https://d.com",
        "https//b.com": "https://b.com", "https::://b.com": "https://b.com", "https:/c.com": "https://c.com", "https:c.com": "https://c.com", "https:///c.com": "https://c.com",
        "ahttps::///c.com": "https://c.com", "httphttp://b.com": "http://b.com", "http://http://b.com": "http://b.com", "httpshttps://b.com": "https://b.com", "https://https://b.com": "https://b.com",
        "https://ww.b.com": "https://www.b.com", "https://wwb.com": "https://www.b.com", "https://wwwwb.com": "https://www.b.com", "https://wwww.b.com": "https://www.b.com", "https://www.b.com": "https://www.b.com",
        "https://a.com/en": "https://a.com/", "https://a.com/en/": "https://a.com/", "https://a.com/enter": "https://a.com/enter", "https://a..b...com": "https://a.b.com", "https://httpbin.org/x": "https://httpbin.org/x",
        "https://a.com/?u=http://b.com/en?x": "https://a.com/?u=http://b.com/en?x", "": "https://", "https://w.com": "https://w.com",
    }
    df = spark.createDataFrame(list(pairs.items()), "u string, want string")
    assert [tuple(r) for r in df.select("want", text.repair_url(F.col("u"))).collect()] == [(w, w) for w in pairs.values()]
    L = F.lit
    assert one(spark, text.urls_to_try(L("a.com")), text.urls_to_try(L("http://a.com")), text.urls_to_try(L(" ")), text.urls_to_try(L("nothing"))) == (["https://a.com"], ["https://a.com", "http://a.com"], None, None)


def test_areas_names_and_addresses(spark):
    L = F.lit
    areas = lambda v: [tuple(a) for a in one(spark, text.service_areas(L(v)))[0]]
    assert areas("15 km|5KM| 07 kms") == [("KILOMETRIQUE", "15"), ("KILOMETRIQUE", "5"), ("KILOMETRIQUE", "7")]
    assert areas("2a|3|974|Drom Tom|FRANCE  métropolitaine|1234|") == [("DEPARTEMENTAL", "03"), ("DEPARTEMENTAL", "2A"), ("DEPARTEMENTAL", "974"), ("DROM_TOM", ""), ("FRANCE_METROPOLITAINE", "")]
    assert areas("France métropolitaine y compris DROM TOM") == [("DROM_TOM", ""), ("FRANCE_METROPOLITAINE", "")]
    assert one(spark, text.format_name(L("sarl dupont")), text.format_name(L("la boîte à lire")), text.format_name(L("ets bcd d or xy"))) == ("SARL Dupont", "La Boîte à lire", "Éts BCD D'Or Xy")
    address = lambda v: tuple(one(spark, text.parse_address(L(v)))[0])
    assert address("123 Rue de Paris 75001 Paris CEDEX 01123") == ("123 Rue de Paris", "75001", "Paris")
    assert address("1 rue, 75001 Paris cedex08") == ("1 rue", "75001", "Paris") and address("75001 Paris") == ("", "75001", "Paris")


def test_small_helpers(spark):
    L = F.lit
    arr = lambda *v: F.array(*[L(x) for x in v])
    assert one(spark, nested.same_items(arr("a", "b"), arr("b", "a")), nested.same_items(arr("a"), arr("b")), nested.as_list(L("x")), nested.as_list(L(None).cast("string"))) == (True, False, ["x"], [])
    assert one(spark, text.null_words_out(arr("a", " None", "-", "b")), text.zip_code_is_invalid(L("7500")), text.zip_code_is_invalid(L("75001")), text.zip_code_is_invalid(L(""))) == (["a", "b"], True, False, False)

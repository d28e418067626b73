import datetime

from pyspark.sql import functions as F

from isobar.operators import dictionary as d

XML = """<?xml version="1.0"?><metadata name="test" version_number="1">
<metvar usage="current" origin="CMC" pack="12" date="2020-01-02"><nomvar ip1="12">TT</nomvar>
<description><short lang="fr">Température</short><short lang="en">Temperature</short><long>Of the air</long></description>
<measure><real><units>C</units><magnitude>0</magnitude><min>-90</min><max>60</max></real></measure></metvar>
<metvar usage="obsolete" origin="CMC" date="2010-01-02"><nomvar>TT</nomvar><description><short>Old</short></description><measure><integer><units>K</units></integer></measure></metvar>
<metvar usage="current" origin="X"><nomvar>PT</nomvar><description><short lang="en">Kind</short></description><measure><code><value>1</value><meaning lang="en">rain</meaning><value>2</value><meaning lang="en">snow</meaning></code></measure></metvar>
<typvar usage="current" origin="CMC"><nomtype>P</nomtype><description><short lang="en">Forecast</short></description></typvar></metadata>"""


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    v = d.read_variables(spark, str(tmp_path / "d.xml"))
    rows = {(r.name, r.origin, r.nature & 255): r for r in v.collect()}
    tt = rows["TT", "CMC", 16]
    assert (tt.short_fr, tt.short_en, tt.long_fr, tt.units, tt.min, tt.ip1, tt.date) == ("Température", "Temperature", "Of the air", "C", -90.0, 12, datetime.date(2020, 1, 2))
    assert rows["PT", "X", 16].codes == [1, 2] and rows["PT", "X", 16].meanings == ["rain", "snow"]
    assert v.filter(d.search("tt")).count() == 2 and v.filter(d.search("tt", state=16)).count() == 1 and v.filter(d.search("^.t$", glob=True)).count() == 3
    assert d.first_of_each(v).filter("name = 'TT'").first().short_en == "Temperature"
    assert [r.name for r in d.ordered(v).collect()] == ["PT", "TT", "TT"]
    m = d.modified(v.filter(d.search("tt", state=16)), F.lit("E1GT10__H024")).first()
    assert (m.short_en, m.units, m.max) == ("Temperature > 10 C between hour 1 and 24", "%", 100.0)
    assert d.modified(v.filter(d.search("tt", state=16)), F.lit("E1C90___NONE")).first().short_fr == "Température (90e centile)"
    assert d.modified(v.filter(d.search("tt", state=16)), F.lit("E1MAX___NONE")).first().short_en == "Temperature (maximum)"
    assert d.report(v.filter(d.search("tt", state=16))).first().text.startswith("TT  \tTemperature")
    t = d.read_types(spark, str(tmp_path / "d.xml"))
    assert d.type_report(t.filter(d.search_type("p"))).first().text == "P \tForecast"
    names = d.configured(spark.createDataFrame([("sortie([TT, UU],x)",), ("x=1",), ("SORTIE( p,[tt])",)], "value string"))
    assert {(r.name, r.n, r.known) for r in d.known_and_unknown(names, v).collect()} == {("TT", 2, True), ("UU", 1, False)}
    assert [r.name for r in d.defined_not_found(names, v).collect()] == ["PT"]

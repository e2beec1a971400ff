import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


LETTER = """<?xml version="1.0" encoding="UTF-8"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="brief-7">
 <teiHeader>
  <fileDesc><titleStmt><title level="s">Briefe</title><title level="a">Brief aus Ulm</title></titleStmt>
   <publicationStmt><publisher>Verlag Muster</publisher><availability><licence target="https://creativecommons.org/licenses/by/4.0/"/></availability></publicationStmt>
   <sourceDesc><p>Erfunden.</p></sourceDesc></fileDesc>
  <encodingDesc><listPrefixDef><prefixDef ident="gnd" matchPattern="([0-9X-]+)" replacementPattern="https://d-nb.info/gnd/$1"/></listPrefixDef></encodingDesc>
  <profileDesc><correspDesc>
   <correspAction type="sent"><persName ref="gnd:123">Clara Berg</persName><placeName ref="#ulm">Ulm</placeName><date when="1821-03-05">5. März 1821</date></correspAction>
   <correspAction type="received"><persName ref="#kurt">Kurt Tal</persName><date notBefore="1821-03-06" notAfter="1821-03-09" cert="low">März 1821</date></correspAction>
  </correspDesc></profileDesc>
 </teiHeader>
 <text><body>
  <opener><dateline>Ulm, den 5. März 1821</dateline></opener>
  <p>Clara Berg grüßt aus <hi>Ulm</hi> den <choice><sic>Kurd</sic><corr>Kurt</corr></choice>.</p>
  <p>Der Verein Ulm kennt auch <placeName ref="#ulm">Ulm</placeName> &amp; Neu.<note>Kurt lebte in Ulm.</note></p>
  <closer>Ihre <signed>Ber<lb break="no"/>ta</signed></closer>
 </body>
 <back><listPlace><place xml:id="ulm"><placeName>Ulm</placeName><idno type="geonames">https://www.geonames.org/2820256</idno></place></listPlace>
  <listPerson><person xml:id="kurt"><persName><forename>Kurt</forename><surname>Tal</surname></persName><idno type="gnd">http://d-nb.info/gnd/456</idno></person></listPerson></back></text>
</TEI>
""".encode()
GLOSSARY = b'{"PER": ["Clara Berg", "Kurt", "Berta"], "LOC": ["Ulm"], "ORG": ["Verein Ulm"]}'


@pytest.fixture
def letter_file(tmp_path):
    path = tmp_path / "brief.xml"
    path.write_bytes(LETTER)
    return str(path)

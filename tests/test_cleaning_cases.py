"""Cleaning cases as a table of (name, level, input, expected)."""

from pyspark.sql import functions as F

from siftgraph.functions import text as X

GLUED_30 = (
    "ממוזער|סרטוט כללי של שסתום בטיחותשסתום בטיחות הוא שסתום המשחרר באופן אוטומטי את התווך הזורם "
    "במערכת אם הלחץ עולה על ערך שניקבע מראש כמסכן את המערכת. מוצא שסתום הבטיחות יכול להיות לאוויר "
    "או שפיכה חופשית או למערכת משנית המיועדת לטפל בחומר ששוחרר."
)
GLUED_24 = (
    "ממוזער|271x271 פיקסליםאלנה גלנדאור מסרה עדות ביד ושם על מנת שיכירו בה כחסידת אומות העולם "
    "והיא אכן הוכרה ככזו בשנת אלפיים ושתיים."
)
# Inputs and expected outputs of the published cleaning rules.
CASES = [
    ("image line", "v3", "ממוזער|left|325px|חתימתו\nטקסט אמיתי כאן.", "טקסט אמיתי כאן."),
    ("placement prefix", "v3", "שמאל|ממוזער|250px|אות שמע\nטקסט אמיתי כאן.", "טקסט אמיתי כאן."),
    ("caption continuation", "v3", "שמאל|ממוזער|250px|אות שמע\n[[פסקול]] בסרט\nטקסט אמיתי כאן.", "טקסט אמיתי כאן."),
    ("long prose stays", "v3", "ממוזער|250px|כיתוב\nזהו משפט ארוך ואמיתי שאסור למחוק אותו בשום אופן שהוא.",
     "זהו משפט ארוך ואמיתי שאסור למחוק אותו בשום אופן שהוא."),
    ("header stays", "v3", "ממוזער|250px|כיתוב\n=== ניסוי ALPHA ===\nטקסט.", "ניסוי ALPHA\nטקסט."),
    ("pixel word", "v3", "שגרירות סין בסטוקהולם|273x273 פיקסלים\nטקסט.", "טקסט."),
    ("frame word", "v3", "שמאל|מסגרת|שכבת גבול סטוקס בתוך זורם צמיג.\nטקסט.", "טקסט."),
    ("flag icon", "v3", "קישור=דנמרק|טקסט=דנמרק|גבול|20px דנמרק\nטקסט.", "טקסט."),
    ("bare placement", "v3", "right\nטקסט.", "טקסט."),
    ("suffix directive", "v3", "דפנה דקל במהלך ביצוע השיר, 1992|ימין\nטקסט.", "טקסט."),
    ("infobox parameter", "v3", "|מסה= 2.9 (כל אחד)\n|גיל=\nטקסט.", "טקסט."),
    ("table cell", "v3", 'width="20px"|\nטקסט.', "טקסט."),
    ("html tag", "v3", "</small>*הנתונים מבוססים.", "הנתונים מבוססים."),
    ("stray pipe", "v3", "דיני ההתיישנות | ארז קמיניץ.", "דיני ההתיישנות ארז קמיניץ."),
    ("size at line start", "v3", "טקסט.\n30px טאיוואן - חוזה של 916 מיליון דולר\nעוד.",
     "טקסט.\nטאיוואן - חוזה של 916 מיליון דולר\nעוד."),
    ("size with dash", "v3", "טקסט.\n20px - כרמית בוריאן\nעוד.", "טקסט.\nכרמית בוריאן\nעוד."),
    ("size inside a sentence", "v3", "המסך מציג ברזולוציה של 1920x1080 פיקסלים והוא איכותי.",
     "המסך מציג ברזולוציה של 1920x1080 פיקסלים והוא איכותי."),
    ("content header", "v3", "פתיח.\n== ביוגרפיה ==\nהמשך.", "פתיח.\nביוגרפיה\nהמשך."),
    ("deep header", "v3", "א.\n=== ניסוי ALPHA ===\nב.", "א.\nניסוי ALPHA\nב."),
    ("nbsp in header", "v3", "א.\n== תפוצה ומרחב ==\nב.", "א.\nתפוצה ומרחב\nב."),
    ("footer", "v3", "גוף המאמר.\n== קישורים חיצוניים ==\nקישור כלשהו", "גוף המאמר."),
    ("nbsp in footer", "v3", "גוף המאמר.\n== קישורים חיצוניים ==\nקישור כלשהו", "גוף המאמר."),
    ("further reading", "v3", "גוף המאמר.\n== לקריאה נוספת ==\nספר כלשהו", "גוף המאמר."),
    ("category line", "v3", "גוף המאמר.\nקטגוריה:סרטים", "גוף המאמר."),
    ("category in prose", "v3", "שינוי הכללים של הקטגוריה: סרטים זכאים חייבים להיות ארוכים.",
     "שינוי הכללים של הקטגוריה: סרטים זכאים חייבים להיות ארוכים."),
    ("piped link", "v3", "ראו [[נפות טורקיה|נפת]] אלזי.", "ראו נפת אלזי."),
    ("plain link", "v3", "ראו [[טורקיה]] היום.", "ראו טורקיה היום."),
    ("bullet", "v3", "* מטה הבנק המרכזי", "מטה הבנק המרכזי"),
    ("v1 misses spaced header", "v1", "גוף.\n== קישורים חיצוניים ==\nקישור", "גוף.\n== קישורים חיצוניים ==\nקישור"),
    ("v1 exact header", "v1", "גוף.\n==ראו גם==\nעוד", "גוף."),
    ("v2 spaced header", "v2", "גוף.\n== ראו גם ==\nעוד", "גוף."),
    ("v2 keeps image lines", "v2", "ממוזער|250px|כיתוב\nגוף.", "ממוזער|250px|כיתוב\nגוף."),
    ("null", "v3", None, ""),
    # line breaks other than the newline, and their place before and after the footer cut
    ("rare breaks", "v3", "a. b.\x0bc.\r\nd.\x85e.", "a.\nb.\nc.\nd.\ne."),
    ("category after a rare break", "v3", "a. קטגוריה:x", "a.\nקטגוריה:x"),
    ("unicode spaces", "v3", " a  b　", "a  b"),
]
ENTITIES = [
    ("טוני בנט שר שירים של [[רוג'רס והארט]]", "טוני בנט שר שירים של רוג'רס והארט"),
    ('אה"מ מגניפיסנט', 'אה"מ מגניפיסנט'),
    ("דנמרק|גבול", "דנמרק גבול"),
    ("ירושלים", "ירושלים"),
    ("[[a [[b|c]] d]]", "a c d"),
]


def test_cases(spark):
    d = spark.createDataFrame(CASES, "name string, level string, input string, want string")
    got = F.when(F.col("level") == "v1", X.clean("input", "v1"))
    got = got.when(F.col("level") == "v2", X.clean("input", "v2")).otherwise(X.clean("input"))
    bad = d.withColumn("got", got).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not bad, bad


def test_sql_functions_agree(spark):
    X.register_sql(spark)
    d = spark.createDataFrame(CASES, "name string, level string, input string, want string")
    for level in X.LEVELS:
        both = d.select("name", X.clean("input", level).alias("a"), F.expr(f"clean_{level}(input)").alias("b"))
        assert both.filter("a <> b").count() == 0


def test_glued_bodies(spark):
    d = spark.createDataFrame([(GLUED_30,), (GLUED_24,)], "t string")
    long, short = [r[0] for r in d.select(X.clean("t")).collect()]
    assert len(long.split()) > 30 and "ממוזער|" not in long
    assert len(short.split()) >= 18 and short.startswith("אלנה")


def test_entities(spark):
    d = spark.createDataFrame(ENTITIES, "t string, want string")
    assert d.filter(X.clean_entity("t") != F.col("want")).count() == 0


def test_long_run_of_captions(spark):
    """A media line followed by thousands of short lines must not exhaust the regex stack."""
    body = "ממוזער|250px|x\n" + "\n".join(["short"] * 20000) + "\nReal text stays here."
    d = spark.createDataFrame([(body,)], "t string")
    assert d.select(X.clean("t")).first()[0] == "Real text stays here."


def test_idempotent_on_plain_text(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").select(X.clean("text").alias("a"))
    assert d.filter(X.clean("a") != F.col("a")).count() == 0


def test_words_match_python(spark):
    rows = [("a b c",), ("  x\x1cy  z",), ("",), ("　",), ("שלום עולם é f",)]
    got = [r[1] for r in spark.createDataFrame(rows, "t string").select("t", X.word_count("t")).collect()]
    assert got == [len(r[0].split()) for r in rows]

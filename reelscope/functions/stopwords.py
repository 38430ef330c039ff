"""Stop words for the topic tokenizer.

The Filipino list is the reference's own. Its English part is a list from another library
that is not available here; the default English list is Spark's own
(``StopWordsRemover.loadDefaultStopWords('english')``), read from the Spark jar so that no
JVM is needed. Pass any other list as an argument.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

# The Filipino stop-word list, in the reference's order (172 entries, some
# repeated, some of two words that never match a single token).
FILIPINO_STOPWORDS = [
    "ang", "ng", "mga", "sa", "yung", "yang", "yon", "yong", "ito", "iyan", "iyon",
    "si", "sina", "ni", "nina", "kay", "kina", "ako", "ko", "ikaw", "ka", "mo",
    "kami", "kita", "tayo", "sila", "siya", "namin", "natin", "ninyo", "nila",
    "akin", "amin", "atin", "inyo", "kanila", "kanya", "kanyang", "at", "o", "ni",
    "para", "kung", "pero", "dahil", "kasi", "basta", "lang", "din", "rin", "daw",
    "raw", "man", "pala", "yata", "nga", "naman", "talaga", "parang", "siguro",
    "marahil", "ay", "na", "pa", "ba", "ho", "po", "ano", "sino", "saan", "kailan",
    "bakit", "paano", "alin", "magkano", "kumusta", "dito", "diyan", "doon",
    "ngayon", "kahapon", "bukas", "mamaya", "kanina", "noon", "may", "mayroon",
    "wala", "walang", "meron", "lahat", "ilan", "marami", "kaunti", "konti", "isa",
    "dalawa", "tatlo", "apat", "lima", "pareho", "iba", "eh", "ayun", "ayos",
    "sige", "oke", "okay", "ah", "oh", "ha", "noh", "di", "mag", "nag", "pag",
    "um", "in", "hin", "an", "han", "ma", "pa", "ka", "maka", "naka", "paka",
    "ganun", "hindi", "dapat", "niya", "sobrang", "nung", "jo", "pagod", "jonathan", "johnrey", "john",
    "rey", "john rey", "babae", "isang", "movie", "filipino", "philippine",
    "philippine cinema", "palibhasa", "ngiti", "ulit", "gets",
    "sunshine", "pelikula", "sana", "yan", "yap", "richard",
    "praybeyt", "nimfa", "nang", "mas", "kahit", "alam", "nay",
    "tay", "la", "la la", "la land", "baka", "baka maakay", "hanggang", "hanggang leeg", "leeg",
]


@functools.lru_cache(maxsize=1)
def english_stopwords() -> tuple[str, ...]:
    """Spark's default English stop words, read from the ML jar."""
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return tuple(w for w in z.read(name).decode("utf-8").split() if w)
    return ()


def default_stopwords() -> list[str]:
    return list(FILIPINO_STOPWORDS) + list(english_stopwords())

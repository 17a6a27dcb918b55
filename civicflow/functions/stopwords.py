"""Stop-word lists.

``english()`` is Spark ML's own default English list (the resource behind
``StopWordsRemover.loadDefaultStopWords("english")``), read from the installed
Spark jar so no JVM is needed to build a plan or its SQL twin.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

# The zone-term page's own stop words, in the page's order.
ZONE_STOP_WORDS = [
    "street", "road", "san", "rafael", "city", "please", "need", "area",
    "would", "like", "also", "one", "two", "three", "located", "side",
    "front", "back", "near", "just", "there", "have", "been", "that",
    "this", "with", "from", "they", "said", "will", "can", "the", "and",
    "for", "are", "not", "but", "has", "was", "its", "it", "at", "on",
    "in", "of", "to", "a", "is", "be", "an", "by", "or", "as", "we",
    "get", "got", "see", "new", "old", "use", "used", "still", "ve",
    "re", "don", "didn", "isn", "hasn", "weren", "couldn", "wouldn",
    "com", "http", "www", "lot", "right", "left", "since", "way", "around",
    "cross", "corner", "block", "along", "between", "across", "make",
    "made", "also", "very", "more", "much", "many", "well", "good", "big",
    "large", "small", "long", "high", "low", "per", "day", "days", "week",
    "time", "year", "month", "number", "years", "months", "weeks",
    "report", "reported", "request", "requested", "issue", "problem",
    "called", "call", "office", "public", "works", "service", "services",
    "department", "address", "resident", "residents", "property",
    "located", "location", "place", "thank", "thanks", "know", "think",
]


@functools.lru_cache(maxsize=None)
def english() -> tuple[str, ...]:
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                words = z.read(name).decode("utf-8").split()
                return tuple(dict.fromkeys(w.strip().lower() for w in words if w.strip()))
    from pyspark.ml.feature import StopWordsRemover  # needs a running JVM

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))

"""The topic taxonomy and the tables derived from it."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.names import first_case
from paperloom.schemas import TAXONOMY

# The topics, in order.
TOPICS = [
    "1.1.1 Economics as a social science",
    "1.1.2 Positive and normative economic statements",
    "1.1.3 The economic problem",
    "1.1.4 Production possibility frontiers",
    "1.1.5 Specialisation and the division of labour",
    "1.1.6 Free market economies, mixed economy and command economy",
    "1.2.1 Rational decision making",
    "1.2.2 Demand",
    "1.2.3 Price, income and cross elasticities of demand",
    "1.2.4 Supply",
    "1.2.5 Elasticity of supply",
    "1.2.6 Price determination",
    "1.2.7 Price mechanism",
    "1.2.8 Consumer and producer surplus",
    "1.2.9 Indirect taxes and subsidies",
    "1.2.10 Alternative views of consumer behaviour",
    "1.3.1 Types of market failure",
    "1.3.2 Externalities",
    "1.3.3 Public goods",
    "1.3.4 Information gaps",
    "1.4.1 Government intervention in markets",
    "1.4.2 Government failure",
    "2.1.1 Economic growth",
    "2.1.2 Inflation",
    "2.1.3 Employment and unemployment",
    "2.1.4 Balance of payments",
    "2.2.1 The characteristics of AD",
    "2.2.2 Consumption (C)",
    "2.2.3 Investment (I)",
    "2.2.4 Government expenditure (G)",
    "2.2.5 Net trade (X-M)",
    "2.3.1 The characteristics of AS",
    "2.3.2 Short-run AS",
    "2.3.3 Long-run AS",
    "2.4.1 National income",
    "2.4.2 Injections and withdrawals",
    "2.4.3 Equilibrium levels of real national output",
    "2.4.4 The multiplier",
    "2.5.1 Causes of growth",
    "2.5.2 Output gaps",
    "2.5.3 Trade (business) cycle",
    "2.5.4 The impact of economic growth",
    "2.6.1 Possible macroeconomic objectives",
    "2.6.2 Demand-side policies",
    "2.6.3 Supply-side policies",
    "2.6.4 Conflicts and trade-offs between objectives and policies",
    "3.1.1 Sizes and types of firms",
    "3.1.2 Business growth",
    "3.1.3 Demergers",
    "3.2.1 Business objectives",
    "3.3.1 Revenue",
    "3.3.2 Costs",
    "3.3.3 Economies and diseconomies of scale",
    "3.3.4 Normal profits, supernormal profits and losses",
    "3.4.1 Efficiency",
    "3.4.2 Perfect competition",
    "3.4.3 Monopolistic competition",
    "3.4.4 Oligopoly",
    "3.4.5 Monopoly",
    "3.4.6 Monopsony",
    "3.4.7 Contestability",
    "3.5.1 Demand for labour",
    "3.5.2 Supply of labour",
    "3.5.3 Wage determination in competitive and non-competitive markets",
    "3.6.1 Government intervention",
    "3.6.2 The impact of government intervention",
    "4.1.1 Globalisation",
    "4.1.2 Specialisation and trade",
    "4.1.3 Pattern of trade",
    "4.1.4 Terms of trade",
    "4.1.5 Trading blocs and the World Trade Organisation (WTO)",
    "4.1.6 Restrictions on free trade",
    "4.1.7 Balance of payments",
    "4.1.8 Exchange rates",
    "4.1.9 International competitiveness",
    "4.2.1 Absolute and relative poverty",
    "4.2.2 Inequality",
    "4.3.1 Measures of development",
    "4.3.2 Factors influencing growth and development",
    "4.3.3 Strategies influencing growth and development",
    "4.4.1 Role of financial markets",
    "4.4.2 Market failure in the financial sector",
    "4.4.3 Role of central banks",
    "4.5.1 Public expenditure",
    "4.5.2 Taxation",
    "4.5.3 Public sector finances",
    "4.5.4 Macroeconomic policies in a global context",
]

# The major sections.
MAJORS = [
    "1.1 Nature of economics",
    "1.2 How markets work",
    "1.3 Market failure",
    "1.4 Government intervention",
    "2.1 Measures of economic performance",
    "2.2 Aggregate demand (AD)",
    "2.3 Aggregate supply (AS)",
    "2.4 National income",
    "2.5 Economic growth",
    "2.6 Macroeconomic objectives and policies",
    "3.1 Business growth",
    "3.2 Business objectives",
    "3.3 Revenues, costs and profits",
    "3.4 Market structures",
    "3.5 Labour market",
    "3.6 Government intervention",
    "4.1 International economics",
    "4.2 Poverty and inequality",
    "4.3 Emerging and developing economies",
    "4.4 The financial sector",
    "4.5 Role of the state in the macroeconomy",
]

CODED = r"^\d+\.\d+\.\d+"


def taxonomy(spark: SparkSession, topics: list[str] = TOPICS) -> DataFrame:
    """(topic, ord) in list order; pass any other list for another specification."""
    rows = pa.table({"topic": topics, "ord": pa.array(range(len(topics)), pa.int32())})
    return spark.createDataFrame(rows, TAXONOMY)


def topic_theme(topic: Column) -> Column:
    digit = F.regexp_extract(topic, r"^([1-4])\.", 1)
    return F.when(digit == "", "Other").otherwise(F.concat(F.lit("Theme "), digit))


def topic_major(topic: Column) -> Column:
    section = F.regexp_extract(topic, r"^(\d+\.\d+)\.\d+", 1)
    return first_case([(section == m.split(" ")[0], F.lit(m)) for m in MAJORS], F.lit("Other"))


def topic_code(topic: Column) -> Column:
    return F.when(topic.rlike(CODED), F.substring_index(topic, " ", 1)).otherwise(topic)


def topic_name(topic: Column) -> Column:
    rest = F.regexp_extract(topic, r"^\d+\.\d+\.\d+[^ ]* (.*)$", 1)
    return F.when(rest == "", topic).otherwise(rest)


def theme_allowed(theme: Column, qualification: Column) -> Column:
    """AS covers themes 1 and 2 only."""
    return ~F.lower(qualification).isin("as level", "as") | theme.isin("Theme 1", "Theme 2")


def describe_topics(topics: DataFrame) -> DataFrame:
    """theme, major, code and name of each topic."""
    t = F.col("topic")
    return topics.select("*", topic_theme(t).alias("theme"), topic_major(t).alias("major"),
                         topic_code(t).alias("code"), topic_name(t).alias("name"))


def topics_of_theme(topics: DataFrame, theme: int) -> DataFrame:
    return topics.filter(F.col("topic").startswith(f"{theme}."))


def title_phrases(topics: DataFrame) -> DataFrame:
    """(topic, phrase): the lower-case title and its and/comma parts of more than 3 characters."""
    bare = F.lower(F.regexp_replace("topic", CODED + r"\s+", ""))
    parts = F.filter(F.transform(F.split(bare, r"\s+and\s+|,\s*"), lambda p: F.trim(p)),
                     lambda p: F.length(p) > 3)
    phrases = F.array_distinct(F.concat(F.array(F.lower("topic")), parts))
    return topics.select("topic", F.explode(phrases).alias("phrase"))


def derived_keywords(topics: DataFrame) -> DataFrame:
    """Default (topic, keyword) table by rule: title parts and title words of more than 3 characters.

    Pass a curated table with the same columns for finer tagging.
    """
    bare = F.lower(F.regexp_replace("topic", CODED + r"\s+", ""))
    words = F.filter(F.split(F.regexp_replace(bare, "[(),]", ""), r"\s+"),
                     lambda w: F.length(w) > 3)
    from_titles = title_phrases(topics).filter(F.col("phrase") != F.lower("topic"))
    return (topics.select("topic", F.explode(words).alias("keyword"))
            .union(from_titles).distinct())

"""Twelve chunks of five candidates, as an index of literals."""

from pyspark.sql import DataFrame, SparkSession

#: chunk, candidate, name, title, section, text, cosine to the question in hundredths.
CHUNKS = [
    ("c01", "k1", "Ada Lovelace", "Junior Frontend Engineer", "professional_summary", "Junior frontend engineer who builds accessible components.", 70),
    ("c02", "k1", "Ada Lovelace", "Junior Frontend Engineer", "languages", "German (native), English (fluent)", 20),
    ("c03", "k2", "Alan Turing", "Senior Designer", "experience", "Designer of accessible flows together with frontend developers on handoff.", 80),
    ("c04", "k2", "Alan Turing", "Senior Designer", "experience", "Data engineering in the cloud. Managed a team of 9 engineers.", 55),
    ("c05", "k3", "Grace Hopper", "Cloud Data Developer", "skills", "Cloud, data, accessibility audits", 60),
    ("c06", "k3", "Grace Hopper", "Cloud Data Developer", "experience", "Supervised 12 employees. Speaks German natively", 35),
    ("c07", "k4", "Kurt Goedel", None, "identity", "Kurt Goedel data platform engineer, cloud", 65),
    ("c08", "k4", "Kurt Goedel", None, "experience", "Managed 6 engineers and delivered 8 projects; German clients, cloud-native stack", 50),
    ("c09", "k5", "Emmy Noether", "Frontend Developer", "education", "MSc in computer science, BSc in mathematics", 40),
    ("c10", "k5", "Emmy Noether", "Frontend Developer", "experience", "Led eleven developers on the web accessibility team; native German", 45),
    ("c11", "k2", "Alan Turing", "Senior Designer", "education", "BSc in computer science. MSc in fine arts", 30),
    ("c12", "k4", "Kurt Goedel", None, "projects", "MSc in computer science", 25),
]


def chunks(spark: SparkSession) -> DataFrame:
    rows = [(*r[:6], [r[6] / 100, (1 - (r[6] / 100) ** 2) ** 0.5]) for r in CHUNKS]
    return spark.createDataFrame(rows, "chunk_id string, candidate_id string, candidate_name string, professional_title string, section_name string, text string, embedding array<double>")

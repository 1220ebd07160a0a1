"""The gazetteer of places and the stop words of three languages."""

from __future__ import annotations

# Name, kind, latitude, longitude. Where a name occurs twice, the first row describes it.
PLACES = [
    ("Centro-Oeste", "região", -15.5, -54.5),
    ("Nordeste", "região", -8.0, -38.0),
    ("Norte", "região", -3.0, -60.0),
    ("Sudeste", "região", -19.0, -45.0),
    ("Sul", "região", -27.0, -51.0),
    ("Distrito Federal", "estado", -15.79, -47.88),
    ("Espírito Santo", "estado", -20.32, -40.34),
    ("Mato Grosso do Sul", "estado", -20.51, -54.54),
    ("Minas Gerais", "estado", -18.10, -44.38),
    ("Rio Grande do Norte", "estado", -5.81, -36.59),
    ("Rio Grande do Sul", "estado", -30.03, -51.22),
    ("Santa Catarina", "estado", -27.45, -50.95),
    ("São Paulo", "estado", -22.19, -48.79),
    ("Rio de Janeiro", "estado", -22.25, -42.66),
    ("Amapá", "estado", 1.41, -51.77),
    ("Amazonas", "estado", -4.20, -63.83),
    ("Bahia", "estado", -12.96, -41.67),
    ("Ceará", "estado", -5.20, -39.53),
    ("Goiás", "estado", -15.98, -49.86),
    ("Maranhão", "estado", -5.42, -45.44),
    ("Mato Grosso", "estado", -12.64, -56.92),
    ("Pará", "estado", -3.79, -52.96),
    ("Paraíba", "estado", -7.28, -36.72),
    ("Paraná", "estado", -24.89, -51.55),
    ("Pernambuco", "estado", -8.38, -37.86),
    ("Piauí", "estado", -6.60, -42.28),
    ("Rondônia", "estado", -10.83, -63.34),
    ("Roraima", "estado", 1.99, -61.33),
    ("Sergipe", "estado", -10.57, -37.45),
    ("Tocantins", "estado", -9.46, -48.26),
    ("Acre", "estado", -9.02, -70.81),
    ("Alagoas", "estado", -9.57, -36.78),
    ("Brasília", "cidade", -15.79, -47.88),
    ("São Paulo", "cidade", -23.55, -46.63),
    ("Rio de Janeiro", "cidade", -22.90, -43.21),
    ("Belo Horizonte", "cidade", -19.92, -43.94),
    ("Salvador", "cidade", -12.97, -38.51),
    ("Fortaleza", "cidade", -3.72, -38.52),
    ("Curitiba", "cidade", -25.42, -49.27),
    ("Recife", "cidade", -8.05, -34.90),
    ("Porto Alegre", "cidade", -30.03, -51.22),
    ("Manaus", "cidade", -3.12, -60.02),
    ("Belém", "cidade", -1.46, -48.50),
    ("Goiânia", "cidade", -16.69, -49.25),
    ("Guarulhos", "cidade", -23.46, -46.53),
    ("Campinas", "cidade", -22.91, -47.06),
    ("São Luís", "cidade", -2.53, -44.30),
    ("Natal", "cidade", -5.79, -35.21),
    ("Florianópolis", "cidade", -27.60, -48.55),
    ("Vitória", "cidade", -20.32, -40.34),
    ("Cuiabá", "cidade", -15.60, -56.10),
    ("Campo Grande", "cidade", -20.47, -54.62),
    ("Brasil", "país", -14.24, -51.93),
    ("Brazil", "país", -14.24, -51.93),
    ("Argentina", "país", -34.60, -58.38),
    ("Estados Unidos", "país", 39.83, -98.58),
    ("United States", "país", 39.83, -98.58),
    ("EUA", "país", 39.83, -98.58),
    ("USA", "país", 39.83, -98.58),
    ("Portugal", "país", 38.72, -9.14),
    ("França", "país", 46.23, 2.21),
    ("France", "país", 46.23, 2.21),
    ("Reino Unido", "país", 55.38, -3.44),
    ("United Kingdom", "país", 55.38, -3.44),
    ("Inglaterra", "país", 52.36, -1.17),
    ("England", "país", 52.36, -1.17),
    ("Espanha", "país", 40.46, -3.75),
    ("Spain", "país", 40.46, -3.75),
    ("Alemanha", "país", 51.17, 10.45),
    ("Germany", "país", 51.17, 10.45),
    ("Itália", "país", 41.87, 12.57),
    ("Italy", "país", 41.87, 12.57),
    ("México", "país", 23.63, -102.55),
    ("Mexico", "país", 23.63, -102.55),
    ("Chile", "país", -35.68, -71.54),
    ("Colômbia", "país", 4.57, -74.30),
    ("Colombia", "país", 4.57, -74.30),
    ("Paraguai", "país", -23.44, -58.44),
    ("Uruguai", "país", -32.52, -55.77),
    ("Uruguay", "país", -32.52, -55.77),
    ("Peru", "país", -9.19, -75.02),
    ("Venezuela", "país", 6.42, -66.59),
    ("Bolívia", "país", -16.29, -63.59),
    ("Bolivia", "país", -16.29, -63.59),
    ("Equador", "país", -1.83, -78.18),
    ("Ecuador", "país", -1.83, -78.18),
    ("Japão", "país", 36.20, 138.25),
    ("Japan", "país", 36.20, 138.25),
    ("China", "país", 35.86, 104.20),
    ("Índia", "país", 20.59, 78.96),
    ("India", "país", 20.59, 78.96),
    ("Rússia", "país", 61.52, 105.32),
    ("Russia", "país", 61.52, 105.32),
    ("Canadá", "país", 56.13, -106.35),
    ("Canada", "país", 56.13, -106.35),
    ("Austrália", "país", -25.27, 133.78),
    ("Australia", "país", -25.27, 133.78),
    ("África", "região", -8.78, 21.09),
    ("Africa", "região", -8.78, 21.09),
    ("Europa", "região", 54.53, 15.25),
    ("Europe", "região", 54.53, 15.25),
    ("América do Sul", "região", -14.24, -51.93),
    ("América do Norte", "região", 54.00, -105.00),
    ("Ásia", "região", 34.05, 100.62),
    ("Asia", "região", 34.05, 100.62),
    ("Lisboa", "cidade", 38.72, -9.14),
    ("Madrid", "cidade", 40.42, -3.70),
    ("Paris", "cidade", 48.86, 2.35),
    ("Londres", "cidade", 51.51, -0.13),
    ("London", "cidade", 51.51, -0.13),
    ("Berlim", "cidade", 52.52, 13.40),
    ("Berlin", "cidade", 52.52, 13.40),
    ("Roma", "cidade", 41.90, 12.50),
    ("Nova York", "cidade", 40.71, -74.01),
    ("New York", "cidade", 40.71, -74.01),
    ("Washington", "cidade", 38.91, -77.04),
    ("Los Angeles", "cidade", 34.05, -118.24),
    ("Cidade do México", "cidade", 19.43, -99.13),
    ("Buenos Aires", "cidade", -34.60, -58.38),
    ("Lima", "cidade", -12.05, -77.04),
    ("Santiago", "cidade", -33.45, -70.67),
    ("Bogotá", "cidade", 4.71, -74.07),
    ("Bogota", "cidade", 4.71, -74.07),
    ("Tóquio", "cidade", 35.68, 139.65),
    ("Tokyo", "cidade", 35.68, 139.65),
    ("Pequim", "cidade", 39.90, 116.41),
    ("Beijing", "cidade", 39.90, 116.41),
    ("Moscou", "cidade", 55.75, 37.62),
    ("Moscow", "cidade", 55.75, 37.62),
    ("João Pessoa", "cidade", -7.12, -34.86),
    ("Aracaju", "cidade", -10.95, -37.07),
    ("Maceió", "cidade", -9.67, -35.74),
    ("Teresina", "cidade", -5.09, -42.80),
    ("São José dos Campos", "cidade", -23.19, -45.88),
]

# Stop words of clouds and counts, by language.
STOP_WORDS = {
    "en": [
        "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "his",
        "they", "be", "at", "one", "have", "this", "from", "or", "had", "by", "not", "but", "what", "some", "we",
        "can", "out", "other", "were", "all", "there", "when", "up", "use", "your", "how", "said", "each", "she",
        "which", "their", "time", "if", "will", "way", "about", "many", "then", "them", "would", "write", "like",
        "so", "these", "her", "long", "make", "thing", "see", "him", "two", "has", "look", "more", "day", "could",
        "go",
    ],
    "es": [
        "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una",
        "su", "al", "lo", "como", "más", "pero", "sus", "le", "ya", "o", "fue", "porque", "esta", "entre", "cuando",
        "muy", "sin", "sobre", "también", "me", "hasta", "hay", "donde", "quien", "desde", "todo", "nos", "durante",
        "estados", "uno", "les", "ni", "contra", "otros", "ese", "eso", "ante", "ellos", "e", "esto", "mí", "antes",
        "algunos", "qué", "unos", "yo", "otro", "muchos", "the", "of", "and", "to", "in", "is", "it", "for", "was",
        "on", "are",
    ],
    "pt": [
        "de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "é", "com", "não", "uma", "os", "no", "se", "na",
        "por", "mais", "as", "dos", "como", "mas", "foi", "ao", "ele", "das", "tem", "à", "seu", "sua", "ou", "ser",
        "quando", "muito", "há", "nos", "já", "está", "eu", "também", "só", "pelo", "pela", "até", "isso", "ela",
        "entre", "era", "depois", "sem", "mesmo", "aos", "ter", "seus", "quem", "nas", "me", "esse", "eles", "estão",
        "você", "tinha", "foram", "essa", "num", "nem", "suas", "meu", "às", "minha", "têm", "numa", "pelos", "elas",
        "havia", "seja", "qual", "será", "nós", "tenho", "lhe", "deles", "essas", "esses", "pelas", "este", "fosse",
        "dele", "tu", "te", "vocês", "vos", "lhes", "meus", "minhas", "teu", "tua", "teus", "tuas", "nosso", "nossa",
        "dela", "delas", "esta", "estes", "estas", "aquele", "aquela", "aqueles", "aquelas", "isto", "aquilo", "the",
        "of", "and", "to", "in", "is", "you", "that", "it", "he", "for", "was", "on", "are", "with", "his", "they",
        "be", "at", "one", "have", "this", "from", "or", "had", "by", "not", "word", "but", "what", "some", "we",
        "can", "out", "other", "were", "all", "there", "when", "up", "use", "your", "how", "said", "each", "she",
        "which", "their", "time",
    ],
}
# Never counted, whatever the language.
NEVER_COUNTED = ["0001", "0002", "xxx"]


def stop_words(lang: str = "pt", extra: str = "") -> list[str]:
    """The stop words of a language tag (Portuguese for one that isn't known), those never counted, and the words of a comma-separated list."""
    known = STOP_WORDS.get((lang or "").strip().lower().replace("_", "-").split("-")[0], STOP_WORDS["pt"])
    more = [w.strip().lower() for w in extra.split(",")]
    return list(dict.fromkeys([*known, *NEVER_COUNTED, *(w for w in more if w)]))

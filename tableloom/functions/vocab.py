"""Short word lists of our own for the text-like generators."""

FIRST_NAMES = (
    "Ada Alma Amir Anika Bela Bruno Carla Chen Dario Dina Elif Emil Farah Felix Greta Hana Hugo Ines Ivan Jana "
    "Jonas Kaya Kofi Lena Luca Maja Marco Nadia Nils Olga Omar Petra Rafael Rosa Samir Sofia Tariq Theo Uma Vera"
).split()
LAST_NAMES = (
    "Abbott Adler Bauer Becker Castro Conti Dahl Duarte Eriksen Farrell Fischer Gallo Haddad Hansen Iyer Janssen "
    "Keller Kowal Laurent Lindgren Marin Mbeki Nakano Novak Okafor Olsen Pereira Quinn Ramos Rossi Sato Silva "
    "Tanaka Torres Ueda Varga Weber Yilmaz Zhang Zimmer"
).split()
JOBS = [
    "Accountant", "Architect", "Baker", "Biologist", "Carpenter", "Chemist", "Data analyst", "Dentist", "Editor",
    "Electrician", "Engineer", "Farmer", "Geologist", "Journalist", "Lawyer", "Librarian", "Mechanic", "Nurse",
    "Optician", "Pharmacist", "Photographer", "Pilot", "Plumber", "Surveyor", "Teacher", "Translator", "Vet",
    "Writer",
]
COMPANY_SUFFIXES = ["Inc", "Ltd", "LLC", "Group", "PLC", "and Sons"]
PHRASE_ADJECTIVES = [
    "Adaptive", "Balanced", "Compact", "Durable", "Flexible", "Focused", "Open", "Proven", "Robust", "Shared",
]
PHRASE_QUALIFIERS = [
    "client-side", "demand-led", "fault-tolerant", "local", "modular", "parallel", "real-time", "scalable",
]
PHRASE_NOUNS = [
    "archive", "forecast", "framework", "interface", "network", "platform", "policy", "protocol", "toolset",
]
WORDS = (
    "able above acre alder amber anchor apple arrow autumn basin beacon birch border branch bridge bright candle "
    "canyon cedar circle clover copper coral cotton crystal delta dune eagle ember field finch forest garden glacier "
    "granite harbor hazel island jasper kettle lantern laurel ledger linen maple marble meadow meteor mirror north "
    "ocean olive orchard paper pebble pine quartz quiet raven ridge river saddle shore silver spruce stone summit "
    "thunder timber valley velvet walnut willow winter"
).split()
TLDS = ["com", "net", "org", "io", "info"]
MAIL_DOMAINS = ["example.com", "example.net", "example.org"]
COUNTRIES = [
    "Argentina", "Australia", "Austria", "Belgium", "Brazil", "Canada", "Chile", "Denmark", "Egypt", "Finland",
    "France", "Germany", "Ghana", "India", "Ireland", "Italy", "Japan", "Kenya", "Mexico", "Morocco",
    "Netherlands", "New Zealand", "Norway", "Peru", "Poland", "Portugal", "Spain", "Sweden", "Switzerland",
    "Turkey",
]
COUNTRY_CODES = [
    "AR", "AU", "AT", "BE", "BR", "CA", "CL", "DK", "EG", "FI", "FR", "DE", "GH", "IN", "IE", "IT", "JP", "KE",
    "MX", "MA", "NL", "NZ", "NO", "PE", "PL", "PT", "ES", "SE", "CH", "TR",
]
CITIES = [
    "Aldermoor", "Bellhaven", "Brightwater", "Carrowby", "Cedarfield", "Dunmere", "Eastvale", "Fernbrook",
    "Glenport", "Hartwell", "Ivybridge", "Kingsmoor", "Larkhill", "Millford", "Northgate", "Oakridge", "Pinecrest",
    "Queensbury", "Riverton", "Stonebridge", "Thornbury", "Underwood", "Westbrook", "Yarrowdale",
]
STREET_SUFFIXES = ["Street", "Avenue", "Road", "Lane", "Way", "Drive", "Court", "Square"]
CURRENCY_CODES = [
    "AUD", "BRL", "CAD", "CHF", "CNY", "CZK", "DKK", "EUR", "GBP", "INR", "JPY", "MXN", "NOK", "NZD", "PLN", "SEK",
    "TRY", "USD", "ZAR",
]
PATH_PARTS = [
    "about", "account", "articles", "cart", "catalog", "help", "home", "news", "orders", "search", "tags", "users",
]
AGENT_PLATFORMS = [
    "Windows NT 10.0; Win64; x64", "Macintosh; Intel Mac OS X 13_4", "X11; Linux x86_64", "Linux; Android 13",
    "iPhone; CPU iPhone OS 16_5 like Mac OS X",
]

# Countries whose basic account number is all digits: code -> number of digits (fixed values of the IBAN registry).
IBAN_DIGITS = {"AT": 16, "BE": 12, "DE": 18, "DK": 14, "EE": 16, "FI": 14, "LT": 16, "NO": 11, "SI": 15}

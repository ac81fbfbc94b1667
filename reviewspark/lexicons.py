"""Word lists, patterns and small dimension tables.

Everything in this module is a *fixed value*: word lists, lookup tables,
constants and patterns that decide results.  They are data, kept apart from the
operators, and every operator takes its lexicon as a parameter, so a deployment
can hand over a larger table read with ``load_pairs`` / ``load_rules``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: label sets -------------------------------------------------
SENTIMENTS = ["positive", "negative", "neutral"]
GOLD_STATUSES = ["approved", "human_approved", "adjudicated", "human_gold", "gold"]
PLACE_GOLD_STATUSES = ["approved", "verified", "human_approved"]
PROTECTED_SPLITS = ["validation", "test", "unseen_test", "diagnostic", "human_review_queue"]
TRAIN_ROLES = ["fit", "inner_tune", "calibration"]
CATEGORIES = [
    "Food Quality", "Beverage Quality", "Service Quality", "Service Speed", "Waiting Time",
    "Staff Attitude", "Professionalism", "Price & Value", "Facilities", "Cleanliness", "Parking",
    "Location & Access", "Ambience", "Portion", "Menu Variety", "Digital Service",
    "Overall Experience", "Other",
]
JOINT_LABELS = ["no_relation", "related_positive", "related_negative", "related_neutral"]
MARKERS = ["[ASP]", "[/ASP]", "[OPN]", "[/OPN]"]

# --- fixed values: label aliases ------------------------------------------------
SENTIMENT_ALIASES = {
    "pos": "positive", "positif": "positive", "positive": "positive",
    "neg": "negative", "negatif": "negative", "negative": "negative",
    "neu": "neutral", "neut": "neutral", "netral": "neutral", "neutral": "neutral",
    "conflict": "conflict", "mixed": "conflict", "positive_negative": "conflict",
    "neg_pos": "conflict", "pos_neg": "conflict",
}
API_SENTIMENT_ALIASES = {
    "positive": "positive", "positif": "positive", "pos": "positive",
    "negative": "negative", "negatif": "negative", "neg": "negative",
    "neutral": "neutral", "netral": "neutral", "neu": "neutral",
}
SPLIT_ALIASES = {
    "dev": "validation", "valid": "validation", "val": "validation", "frozen_diagnostic": "diagnostic",
}
STATUS_RANK = {"approved": 5, "verified": 5, "human_approved": 5, "corrected": 4, "pending": 1}
ID_STATUS_RANK = {"approved": 4, "verified": 4, "human_approved": 4, "corrected": 3, "pending": 1}
DOMAIN_ALIASES = {
    "cafe": "food_beverage", "coffee_shop": "food_beverage", "coffeeshop": "food_beverage",
    "restaurant": "food_beverage", "fnb": "food_beverage",
    "rs": "healthcare", "rumah_sakit": "healthcare", "hospital": "healthcare",
    "puskesmas": "healthcare", "clinic": "healthcare", "klinik": "healthcare",
}
CSV_ROLE_ALIASES = {
    "review": ["review", "review_text", "text", "comment", "komentar", "ulasan", "isi review"],
    "customer_id": ["customer_id", "customer", "id"],
    "city": ["city", "kota", "regency", "kabupaten"],
    "province": ["province", "provinsi"],
}
CUSTOMER_CLASSES = {"1": "VIP", "2": "SILVER", "3": "REGULER"}

# --- fixed values: normalizer layers --------------------------------------------
SOFT_KEY_WORDS = {
    "gk": "tidak", "ga": "tidak", "gak": "tidak", "nggak": "tidak", "ngga": "tidak", "tdk": "tidak",
    "bgt": "banget", "bngt": "banget", "tp": "tapi", "tpi": "tapi", "pdhl": "padahal",
    "udh": "sudah", "sdh": "sudah", "blm": "belum", "krn": "karena", "dgn": "dengan",
    "nunggu": "menunggu", "mnt": "menit", "mins": "menit", "luv": "love", "gud": "good", "gr8": "great",
}
ABBREVIATIONS = {"w/": "with", "w/o": "without"}
UNITS = {
    "mnt": "menit", "menit": "menit", "jam": "jam", "dtk": "detik", "detik": "detik",
    "km": "km", "meter": "meter", "rb": "ribu", "ribu": "ribu", "k": "ribu",
}
NEGATIONS = {
    "ga": "tidak", "gak": "tidak", "nggak": "tidak", "ngga": "tidak", "tdk": "tidak",
    "never": "never", "not": "not", "bukan": "bukan", "tidak": "tidak",
}
INTENSIFIERS = {
    "bgt": "banget", "bngt": "banget", "bgtt": "banget", "sangat": "sangat", "banget": "banget",
    "super": "super", "very": "very", "too": "too",
}
# The whole Indonesian slang table of 473 entries; a deployment's own table is a parameter.
ID_SLANG = {
    "yg": "yang", "yng": "yang", "bgt": "banget", "bngt": "banget", "bgtt": "banget", "bgttt": "banget",
    "pdhl": "padahal", "pdahal": "padahal", "tp": "tapi", "tpi": "tapi", "krn": "karena", "karna": "karena",
    "dgn": "dengan", "dg": "dengan", "dengn": "dengan", "dri": "dari", "sm": "sama", "sma": "sama",
    "sama2": "sama-sama", "sampe": "sampai", "ampe": "sampai", "sampek": "sampai", "nyampe": "sampai", "gk": "tidak",
    "ga": "tidak", "gak": "tidak", "gx": "tidak", "nggak": "tidak", "ngga": "tidak", "enggak": "tidak",
    "engga": "tidak", "kagak": "tidak", "tdk": "tidak", "blm": "belum", "blom": "belum", "belom": "belum",
    "udh": "sudah", "udah": "sudah", "sdh": "sudah", "dah": "sudah", "klo": "kalau", "kl": "kalau", "kalo": "kalau",
    "jd": "jadi", "jdi": "jadi", "trs": "terus", "trus": "terus", "trz": "terus", "cm": "cuma", "cman": "cuma",
    "cuman": "cuma", "gw": "saya", "gue": "saya", "gua": "saya", "sy": "saya", "sya": "saya", "aq": "saya",
    "kmrn": "kemarin", "kmaren": "kemarin", "kemaren": "kemarin", "skrg": "sekarang", "skr": "sekarang", "bs": "bisa",
    "bsa": "bisa", "hrs": "harus", "hrus": "harus", "emg": "memang", "emang": "memang", "bkn": "bukan",
    "org": "orang", "orng": "orang", "tmpt": "tempat", "tempet": "tempat", "jgn": "jangan", "jng": "jangan",
    "knp": "kenapa", "kenap": "kenapa", "gmn": "bagaimana", "gmna": "bagaimana", "gimana": "bagaimana",
    "bgmn": "bagaimana", "utk": "untuk", "u/": "untuk", "biar": "supaya", "spy": "supaya", "kyk": "seperti",
    "kayak": "seperti", "kek": "seperti", "smoga": "semoga", "moga": "semoga", "msh": "masih", "msih": "masih",
    "sblm": "sebelum", "seblm": "sebelum", "stlh": "setelah", "lg": "lagi", "lgi": "lagi", "dlu": "dulu",
    "dl": "dulu", "ntar": "nanti", "ntr": "nanti", "entar": "nanti", "bsk": "besok", "mlm": "malam", "malem": "malam",
    "pgi": "pagi", "org2": "orang-orang", "anak2": "anak-anak", "ibu2": "ibu-ibu", "bapak2": "bapak-bapak",
    "mba": "mbak", "mb": "mbak", "pak": "bapak", "bpk": "bapak", "bu": "ibu", "kak": "kakak", "min": "admin",
    "mimin": "admin", "minn": "admin", "adminn": "admin", "thx": "terima kasih", "thanks": "terima kasih",
    "thankyou": "terima kasih", "tq": "terima kasih", "tks": "terima kasih", "mksh": "terima kasih",
    "makasih": "terima kasih", "makasi": "terima kasih", "trims": "terima kasih", "trimakasih": "terima kasih",
    "pls": "tolong", "plis": "tolong", "please": "tolong", "sorry": "maaf", "sory": "maaf", "sori": "maaf",
    "maap": "maaf", "maf": "maaf", "bgs": "bagus", "bgus": "bagus", "mantab": "mantap", "mantabb": "mantap",
    "mantul": "mantap", "mantep": "mantap", "mantapp": "mantap", "toppp": "bagus", "topmarkotop": "sangat bagus",
    "recommended": "direkomendasikan", "recommend": "direkomendasikan", "rekomen": "direkomendasikan",
    "recomended": "direkomendasikan", "recomend": "direkomendasikan", "rekomended": "direkomendasikan",
    "worthit": "sepadan", "worth-it": "sepadan", "okee": "baik", "okey": "baik", "okay": "baik", "goodd": "bagus",
    "goood": "bagus", "great": "sangat bagus", "awesome": "sangat bagus", "amazing": "sangat bagus",
    "excellent": "sangat bagus", "perfect": "sempurna", "jos": "bagus", "joss": "bagus", "sip": "bagus",
    "sipp": "bagus", "kereen": "bagus", "kerenn": "bagus", "love": "suka", "luv": "suka", "gercep": "cepat",
    "satset": "cepat", "murmer": "murah", "bad": "buruk", "badd": "buruk", "verybad": "sangat buruk",
    "zonk": "mengecewakan", "zonkk": "mengecewakan", "lelet": "lambat", "lemot": "lambat", "jutek": "tidak ramah",
    "judes": "tidak ramah", "ketus": "tidak ramah", "songong": "tidak ramah", "cuek": "tidak responsif",
    "ribet": "rumit", "rempong": "rumit", "jorok": "kotor", "jorokk": "kotor", "overprice": "terlalu mahal",
    "overpriced": "terlalu mahal", "gaenak": "tidak enak", "gakenak": "tidak enak",
    "notrecommended": "tidak direkomendasikan", "pelayananya": "pelayanannya", "pelayannnya": "pelayanannya",
    "pelayannya": "pelayanannya", "pelayannannya": "pelayanannya", "pelayananannya": "pelayanannya",
    "pelayann": "pelayanan", "layanananya": "layanannya", "service": "pelayanan", "servis": "pelayanan",
    "servicenya": "pelayanannya", "servisnya": "pelayanannya", "staff": "staf", "staffnya": "stafnya",
    "petugass": "petugas", "pegawainyaa": "pegawainya", "slowrespon": "lambat merespons",
    "slowresponse": "lambat merespons", "slowresp": "lambat merespons", "fastrespon": "cepat merespons",
    "fastresponse": "cepat merespons", "responsive": "responsif", "helpfull": "membantu", "helpful": "membantu",
    "friendly": "ramah", "unfriendly": "tidak ramah", "antri": "antre", "antrian": "antrean",
    "antriannya": "antreannya", "antriann": "antrean", "ngantri": "mengantre", "ngantre": "mengantre",
    "queue": "antrean", "waiting": "menunggu", "wait": "menunggu", "nunggu": "menunggu", "nungguin": "menunggu",
    "kelamaan": "terlalu lama", "parkiran": "area parkir", "parkirannya": "area parkirnya",
    "parkiranya": "area parkirnya", "parking": "parkir", "vallet": "valet", "maps": "peta", "gmap": "google maps",
    "gmaps": "google maps", "nyasar": "tersesat", "kesasar": "tersesat", "acces": "akses", "access": "akses",
    "jln": "jalan", "jl": "jalan", "facilities": "fasilitas", "facility": "fasilitas", "wc": "toilet",
    "toilet nya": "toiletnya", "musholla": "musala", "mushola": "musala", "musholah": "musala", "wi-fi": "wifi",
    "wifi nya": "wifi", "clean": "bersih", "cleaning": "kebersihan", "debuan": "berdebu", "pesing": "bau urine",
    "coffeshop": "coffee shop", "coffeeshop": "coffee shop", "coffee-shop": "coffee shop",
    "coffe shop": "coffee shop", "cofee shop": "coffee shop", "caffe": "kafe", "café": "kafe", "resto": "restoran",
    "restaurant": "restoran", "restauran": "restoran", "makananya": "makanannya", "mknannya": "makanannya",
    "makannannya": "makanannya", "mkanan": "makanan", "mknan": "makanan", "minumanya": "minumannya",
    "mnman": "minuman", "food": "makanan", "foods": "makanan", "drink": "minuman", "drinks": "minuman",
    "taste": "rasa", "yummy": "enak", "yumm": "enak", "delicious": "enak", "coffee": "kopi",
    "cappucino": "cappuccino", "capucino": "cappuccino", "expresso": "espresso", "espreso": "espresso",
    "cashier": "kasir", "waiter": "pramusaji", "waitress": "pramusaji", "orderan": "pesanan", "pesen": "pesan",
    "mesen": "memesan", "pesenan": "pesanan", "takeaway": "bawa pulang", "take-away": "bawa pulang",
    "dinein": "makan di tempat", "dine-in": "makan di tempat", "ambience": "suasana", "ambiance": "suasana",
    "vibes": "suasana", "vibe": "suasana", "cozy": "nyaman", "comfy": "nyaman", "instagramable": "instagrammable",
    "aesthetic": "estetis", "aestetik": "estetis", "estetik": "estetis", "nongki": "nongkrong",
    "wfc": "work from cafe", "smokingarea": "area merokok", "nosmoking": "dilarang merokok", "outdor": "outdoor",
    "indor": "indoor", "portion": "porsi", "price": "harga", "hrg": "harga", "rmh sakit": "rumah sakit",
    "puskes": "puskesmas", "pusk": "puskesmas", "clinic": "klinik", "nurse": "perawat", "nakes": "tenaga kesehatan",
    "apotik": "apotek", "apotekk": "apotek", "pharmacy": "apotek", "laborat": "laboratorium", "xray": "rontgen",
    "x-ray": "rontgen", "medicalcheckup": "pemeriksaan kesehatan", "medical checkup": "pemeriksaan kesehatan",
    "checkup": "pemeriksaan", "rawatinap": "rawat inap", "rawatjalan": "rawat jalan", "ranap": "rawat inap",
    "rajal": "rawat jalan", "diagnosa": "diagnosis", "registration": "pendaftaran", "pemda": "pemerintah daerah",
    "pemkot": "pemerintah kota", "pemkab": "pemerintah kabupaten", "pemprov": "pemerintah provinsi",
    "dukcapil": "dinas kependudukan dan pencatatan sipil", "disdukcapil": "dinas kependudukan dan pencatatan sipil",
    "disduk": "dinas kependudukan", "dinkes": "dinas kesehatan", "disnaker": "dinas tenaga kerja",
    "dishub": "dinas perhubungan", "dinsos": "dinas sosial", "disdik": "dinas pendidikan", "ektp": "KTP elektronik",
    "e-ktp": "KTP elektronik", "e ktp": "KTP elektronik", "passport": "paspor", "ijin": "izin",
    "fotocopy": "fotokopi", "foto copy": "fotokopi", "mall pelayanan publik": "mal pelayanan publik",
    "banking": "perbankan", "custservice": "layanan pelanggan", "cust service": "layanan pelanggan",
    "customer-service": "layanan pelanggan", "mbanking": "mobile banking", "m-banking": "mobile banking",
    "m banking": "mobile banking", "mobilebanking": "mobile banking", "ibanking": "internet banking",
    "i-banking": "internet banking", "internetbanking": "internet banking", "creditcard": "kartu kredit",
    "credit card": "kartu kredit", "adminfee": "biaya administrasi", "admin fee": "biaya administrasi",
    "bansos": "bantuan sosial", "blt": "bantuan langsung tunai", "sembako": "bantuan sembako",
    "difabel": "penyandang disabilitas", "panti jompo": "panti lansia", "sekolahan": "sekolah", "univ": "universitas",
    "university": "universitas", "perpus": "perpustakaan", "library": "perpustakaan", "guesthouse": "penginapan",
    "guest house": "penginapan", "homestay": "penginapan", "room": "kamar", "receptionist": "resepsionis",
    "reception": "resepsionis", "checkin": "check-in", "check in": "check-in", "checkout": "check-out",
    "check out": "check-out", "breakfast": "sarapan", "pool": "kolam renang", "swimmingpool": "kolam renang",
    "store": "toko", "shop": "toko", "mall": "pusat perbelanjaan", "product": "produk", "stock": "stok",
    "discount": "diskon", "disc": "diskon", "promotion": "promosi", "service mobil": "servis mobil",
    "service motor": "servis motor", "mechanic": "mekanik", "sparepart": "suku cadang", "spare part": "suku cadang",
    "onderdil": "suku cadang", "carwash": "pencucian mobil", "car wash": "pencucian mobil", "station": "stasiun",
    "commuterline": "kereta komuter", "commuter line": "kereta komuter", "ojol": "ojek online",
    "ojekonline": "ojek online", "driver": "pengemudi", "supir": "pengemudi", "ticket": "tiket",
    "view": "pemandangan", "scenery": "pemandangan", "photo": "foto", "familyfriendly": "ramah keluarga",
    "family friendly": "ramah keluarga", "kidsfriendly": "ramah anak", "kids friendly": "ramah anak",
    "kidfriendly": "ramah anak", "app": "aplikasi", "apps": "aplikasi", "apk": "aplikasi", "web": "situs web",
    "system": "sistem", "eror": "error", "errorr": "error", "err": "error", "bug": "gangguan sistem",
    "bugs": "gangguan sistem", "server down": "server tidak dapat diakses", "loading lama": "lambat memuat",
    "log in": "masuk", "log out": "keluar", "notif": "notifikasi", "notification": "notifikasi",
    "callcenter": "call center", "custcare": "layanan pelanggan", "wa": "WhatsApp", "w.a": "WhatsApp",
    "telp": "telepon", "tlp": "telepon", "telfon": "telepon", "telefon": "telepon", "telpon": "telepon",
    "bales": "balas", "dibales": "dibalas", "komplain": "keluhan", "complain": "keluhan", "complaint": "keluhan",
    "komplenan": "keluhan", "kwalitas": "kualitas", "aktifitas": "aktivitas", "resiko": "risiko",
    "praktek": "praktik", "sekedar": "sekadar", "rapih": "rapi", "nafas": "napas", "jaman": "zaman",
    "silahkan": "silakan", "nomer": "nomor",
}
EN_SLANG = {
    "luv": "love", "gr8": "great", "gud": "good", "thx": "thanks", "pls": "please", "plz": "please",
    "tho": "though", "u": "you", "ur": "your", "b4": "before",
}
ID_TYPOS = {
    "kmar": "kamar", "brsih": "bersih", "servisnyaa": "servisnya", "pelayannnya": "pelayanannya",
    "antriann": "antrean",
}
EN_TYPOS = {"freindly": "friendly", "reciept": "receipt", "servce": "service", "restarant": "restaurant"}
DOMAIN_TERMS = {
    "food_beverage": {"cs": "coffee shop"},
    "healthcare": {
        "dr": "dokter", "drg": "dokter gigi", "rs": "rumah sakit", "rsu": "rumah sakit umum",
        "rsud": "rumah sakit umum daerah", "pkm": "puskesmas", "igd": "instalasi gawat darurat",
        "ugd": "unit gawat darurat", "lab": "laboratorium", "mcu": "pemeriksaan kesehatan",
        "bpjs": "BPJS", "jkn": "JKN", "kis": "KIS",
    },
    "government": {
        "kk": "kartu keluarga", "ktp": "kartu tanda penduduk", "mpp": "mal pelayanan publik",
        "sim": "surat izin mengemudi", "stnk": "surat tanda nomor kendaraan",
        "skck": "surat keterangan catatan kepolisian", "fc": "fotokopi",
    },
    "banking": {
        "cs": "customer service", "tf": "transfer", "rek": "rekening", "cc": "kartu kredit",
        "kpr": "kredit pemilikan rumah", "atm": "ATM", "qris": "QRIS",
    },
    "social_service": {
        "pm": "penerima manfaat", "pkh": "program keluarga harapan", "bpnt": "bantuan pangan non tunai",
        "dtks": "data terpadu kesejahteraan sosial", "pbi": "penerima bantuan iuran",
        "kip": "kartu indonesia pintar", "kks": "kartu keluarga sejahtera",
    },
    "transportation": {"tj": "TransJakarta", "krl": "kereta rel listrik", "mrt": "MRT", "lrt": "LRT"},
    "education": {
        "tu": "tata usaha", "sd": "sekolah dasar", "smp": "sekolah menengah pertama",
        "sma": "sekolah menengah atas", "smk": "sekolah menengah kejuruan",
    },
}
EMOJI_TOKENS = {
    "👍": "[EMOJI_POS]", "❤️": "[EMOJI_POS]", "❤": "[EMOJI_POS]", "😍": "[EMOJI_POS]",
    "😊": "[EMOJI_POS]", "😁": "[EMOJI_POS]", "👎": "[EMOJI_NEG]", "😡": "[EMOJI_NEG]",
    "😠": "[EMOJI_NEG]", "😞": "[EMOJI_NEG]", "😢": "[EMOJI_NEG]", "🤮": "[EMOJI_NEG]",
    "😐": "[EMOJI_NEU]", "🤔": "[EMOJI_NEU]",
}
EMOJI_PATTERN = (
    r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}](?:[\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
    r"|\x{200D}[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*)*"
)
TOKEN_PATTERN = (
    r"(?Uis)\[/?(?:ASP|OPN|DOC|CTX)\]|\[(?:EMOJI_POS|EMOJI_NEG|EMOJI_NEU)\]"
    r"|https?://\S+|www\.\S+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
    r"|#[\w_]+|\+?\d[\d() .-]{7,}\d|\b(?:w/|w/o)\b"
    r"|\b\d+(?:[.,]\d+)?(?:mnt|menit|jam|dtk|detik|km|meter|rb|ribu|k)\b"
    r"|\b[\w]+(?:-[\w]+)*\b|\s+|" + EMOJI_PATTERN + r"|."
)
PROTECTED_MARKERS = [
    "[ASP]", "[/ASP]", "[OPN]", "[/OPN]", "[DOC]", "[/DOC]", "[CTX]", "[/CTX]",
    "[EMOJI_POS]", "[EMOJI_NEG]", "[EMOJI_NEU]",
]

# --- fixed values: language and domain markers ------------------------------------
ID_MARKERS = [
    "yang", "dan", "tapi", "tetapi", "tidak", "nggak", "gak", "ga", "sangat", "banget", "pelayanan",
    "makanan", "minuman", "harga", "tempat", "ramah", "lambat", "enak", "mahal", "murah", "parkir",
    "lokasi", "saya", "kami",
]
EN_MARKERS = [
    "the", "and", "but", "not", "very", "service", "food", "drink", "price", "place", "staff",
    "friendly", "slow", "good", "bad", "great", "expensive", "cheap", "parking", "location", "was",
    "were", "is", "are", "my", "our",
]
DECLARED_LANGUAGES = ["id", "en", "id-en", "ja", "ar"]
DOMAIN_HINTS = {
    "food_beverage": ["coffee shop", "kafe", "restoran", "kopi", "barista", "menu", "makanan", "minuman", "kasir"],
    "healthcare": ["rumah sakit", "puskesmas", "klinik", "dokter", "perawat", "farmasi", "apotek", "bpjs", "igd", "poli"],
    "government": ["dukcapil", "kelurahan", "kecamatan", "pemkot", "pemkab", "pemprov", "perizinan", "ktp", "paspor", "samsat"],
    "banking": ["bank", "teller", "rekening", "atm", "mobile banking", "transfer", "kredit", "tabungan"],
    "social_service": ["dinas sosial", "bansos", "pkh", "dtks", "pbi", "bantuan sosial", "penerima manfaat"],
    "education": ["sekolah", "kampus", "universitas", "guru", "dosen", "tata usaha", "perpustakaan"],
    "transportation": ["stasiun", "terminal", "halte", "kereta", "bus", "transjakarta", "mrt", "lrt", "ojek"],
}
SEMANTIC_DOMAINS = [
    ("healthcare", r"\b(dokter|poli|antrean poli|perawat|farmasi)\b"),
    ("food_beverage", r"\b(kopi|barista|kasir|menu|minuman|makanan)\b"),
    ("hospitality", r"\b(kamar|hotel|resepsionis|check-in|checkin)\b"),
    ("education", r"\b(sekolah|kampus|guru|dosen|kelas)\b"),
    ("automotive", r"\b(bengkel|mekanik|servis mobil|servis motor)\b"),
]

# --- fixed values: span and pairing patterns --------------------------------------
ASPECT_PATTERNS = [
    ("Waiting Time", r"\b(?:waktu\s+tunggu(?:nya)?|masa\s+tunggu|antrean(?:nya)?|antrian(?:nya)?|waiting\s+time|wait(?:ing)?)\b"),
    ("Waiting Time", r"待ち時間|待ち|وقت\s*الانتظار|الانتظار"),
    ("Staff Attitude", r"\b(?:barista(?:nya)?|kasir(?:nya)?|staf(?:nya)?|staff|pegawai(?:nya)?|pelayan(?:nya)?|employee|waiter|waitress|server)\b"),
    ("Staff Attitude", r"スタッフ|店員|従業員|الموظف(?:ون|ين)?|العامل(?:ون|ين)?|النادل"),
    ("Price & Value", r"\b(?:harga(?:nya)?|biaya(?:nya)?|tarif(?:nya)?|price|cost|charge|fee)\b"),
    ("Price & Value", r"料金|価格|値段|رسوم|سعر|تكلفة"),
    ("Beverage Quality", r"\b(?:kopi(?:nya)?|coffee|americano|latte|espresso|cappuccino|minuman(?:nya)?|drink)\b"),
    ("Beverage Quality", r"コーヒー|飲み物|القهوة|المشروب"),
    ("Food Quality", r"\b(?:makanan(?:nya)?|masakan(?:nya)?|food|meal|dish|menu)\b"),
    ("Food Quality", r"料理|食事|الطعام|الوجبة"),
    ("Service Quality", r"\b(?:pelayanan(?:nya)?|layanan(?:nya)?|service|pesanan(?:nya)?|order)\b"),
    ("Service Quality", r"サービス|注文|الخدمة|الطلب"),
]
OPINION_PATTERNS = [
    ("negative_quality", r"\b(?:mengecewakan|kecewa|buruk|tidak\s+enak|gak\s+enak|bad|disappoint(?:ing|ed)?|awful|terrible)\b|悪く|残念|سيئ|مخيب"),
    ("duration", r"\b(?:hampir\s+)?(?:satu|dua|tiga|setengah|\d+)\s*(?:jam|menit|mnt)\b|\b(?:almost\s+)?(?:one|two|three|half|thirty|forty(?:-?five)?|sixty|\d+)(?:-|\s)+(?:hours?|minutes?|hour|minute)\b|\d+\s*時間|\d+\s*分|ساعة|دقيقة"),
    ("waiting", r"\b(?:lama|lambat|menunggu|nunggu|slow|late|delayed|waited)\b|遅い|待た|بطيء|انتظر"),
    ("staff_action", r"\b(?:meminta|minta)\s+maaf\b|\b(?:mengganti|menggantikan|membuat\s+ulang|bikin\s+ulang)\s+(?:pesanan|minuman|makanan)?\b|\b(?:apologi[sz]ed?|said\s+sorry|replaced?|remade|helped)\b|謝罪|作り直|交換|اعتذر|استبدل"),
    ("free", r"\b(?:tanpa\s+(?:biaya|charge)|gratis|for\s+free|free\s+of\s+charge|no\s+(?:extra\s+)?charge)\b|無料|追加料金なし|دون\s+رسوم|بدون\s+رسوم|مجانا"),
    ("positive", r"\b(?:ramah|cepat|bagus|enak|membantu|friendly|quick|good|helpful|excellent)\b|親切|良い|おいしい|سريع|ودود|جيد|لذيذ"),
    ("neutral", r"\b(?:standar|biasa\s+saja|standard|average)\b|普通|عادي"),
]
EXPLICIT_HEAD_PATTERNS = [
    r"\b(?:mba|mbak|mas|kak)\s+(?:kasir(?:nya)?|barista(?:nya)?|dokter(?:nya)?|perawat(?:nya)?|bidan(?:nya)?)\b",
    r"\b(?:kasir(?:nya)?|barista(?:nya)?|dokter(?:nya)?|perawat(?:nya)?|bidan(?:nya)?|farmasi(?:nya)?)\b",
    r"\b(?:musholla(?:nya)?|mushola(?:nya)?|musala(?:nya)?|toilet(?:nya)?|parkiran(?:\s+mobil)?|ruang\s+tunggu)\b",
    r"\b(?:service\s*speed|servicenya|pelayanannya|antrean(?:nya)?|antrian(?:nya)?)\b",
    r"\b(?:iced?\s+)?americano(?:nya)?\b",
    r"\b(?:cappuccino|cappucino|latte|espresso|matcha)(?:nya)?\b",
    r"\b(?:chicken\s+)?pasta(?:nya)?\b",
]
FACTUAL_HEAD_PATTERNS = [
    r"\b(?:harga(?:nya)?|biaya(?:nya)?|tarif(?:nya)?|price)\b",
    r"\b(?:lokasi(?:nya)?|letak(?:nya)?|akses(?:nya)?)\b",
]
OPERATIONAL_HEADS = r"\b(?:proses(?:nya)?|pelayanan(?:nya)?|layanan(?:nya)?|antrean(?:nya)?|antrian(?:nya)?|waktu\s+tunggu)\b"
SPEED_CUES = r"\b(lama|lambat|cepat|nunggu|menunggu|terlambat)\b"
PAIR_BARRIER = r"[.!?;]|\b(?:tapi|but|melainkan|namun)\b"
COORDINATORS = r"^(?:dan|and|serta|&|と|و)$"
NEGATION_BOUNDARY = r"[,;.!?]|\b(?:tapi|tp|but|namun|melainkan|although)\b"
NEGATION_WORDS = r"\b(?:tidak|tak|bukan|belum|ga|gak|nggak|not|never|no)\b"
CLAUSE_CUT = r"[,.\n;]|\btetapi\b|\btapi\b|\bnamun\b|\bcuma\b|\bhanya\b"
LOCAL_CONTRAST = r"\b(tapi|tetapi|namun|sedangkan|walaupun|meskipun|cuma|sayangnya)\b"
CONTRAST_TARGETS = [
    "harga", "pelayanan", "service", "makanan", "minuman", "kopi", "pasta", "toilet", "musholla",
    "mushola", "musala", "parkir", "lokasi", "dokter", "perawat", "antrean", "antrian", "kamar", "staf",
    "staff", "kasir", "barista", "wifi", "fasilitas", "atm", "teller", "rekening", "petugas", "produk",
    "kualitas",
]
FEATURE_SENTENCE = r"[.!?]+(?:\s+|$)"
FEATURE_CLAUSE = r"(?i)[,;:]|(?<!\w)(?:tapi|tetapi|namun|but|however|yet)(?!\w)"
FEATURE_NEGATION = r"(?<!\w)(?:tidak|tak|bukan|belum|kurang|ga|gak|nggak|ngga|not|never|hardly)(?!\w)"
FEATURE_CONTRAST = r"(?<!\w)(?:tapi|tetapi|namun|melainkan|sedangkan|but|however|although|whereas|yet)(?!\w)"
FEATURE_ID = r"\b(?:tidak|banget|bagus|buruk|pelayanan|harga|yang|dan|tapi)\b"
FEATURE_EN = r"\b(?:not|very|good|bad|service|price|the|and|but)\b"
EVALUATIVE_CUES = (
    r"\b(enak+|bagus|baik|ramah|bersih|nyaman|adem|sejuk|luas|cepat|gercep|membantu|helpful|responsif|"
    r"respon|minta\s+maaf|bikin\s+ulang|dibuat\s+ulang|gratis|tanpa\s+charge|lama+|lambat|kotor|mahal|"
    r"pricey|sempit|kecil|susah|sulit|beda|asin|keasinan|pahit|hambar|dikit|sedikit|kecewa|jutek|judes|"
    r"standar|biasa\s+saja|masih\s+oke|worth\s+it|harus\s+dibenerin|\d+\s*(?:mnt|menit|jam))\b"
)
STRONG_NEGATIVE = (
    r"\b(susah|sulit|kotor|jutek|judes|kecewa|terlalu\s+lama|lama+|lambat|sempit|kecil\s+banget|"
    r"agak\s+kecil|rasanya\s+beda|rasa(?:nya)?\s+beda|keasinan|tidak\s+enak|ga\s+enak|gak\s+enak|"
    r"nggak\s+enak|agak\s+dikit|terlalu\s+sedikit|harus\s+dibenerin|hampir\s+\d+\s*(?:mnt|menit|jam)|"
    r"\d+\s*(?:mnt|menit|jam))\b"
)
STRONG_POSITIVE = (
    r"\b(ramah|bersih|nyaman|enak+|bagus|baik|membantu|helpful|responsif|langsung\s+respon|"
    r"minta\s+maaf|bikin\s+ulang|dibuat\s+ulang|gratis|tanpa\s+charge)\b"
)
POSITIVE_CUES = r"\b(enak|bagus|ramah|cepat|bersih|nyaman|murah|mantap|puas|sepadan)\b"
NEGATIVE_CUES = r"\b(lama|lambat|mahal|kotor|jutek|buruk|jelek|asin|keasinan|sempit|ribet|bau|kecewa)\b"
SLICE_NEGATION = r"\b(tidak|tak|bukan|belum|jangan|ga|gak|nggak|no|not|never|isn't|wasn't)\b"
COREFERENCE = r"\b(?:ini|itu|dia|mereka|beliau|tersebut)\b|\b\w+nya\b"
TEMPLATE_SLOTS = r"\b(enak|murah|ramah|lama|mahal|bagus|bersih|kotor)\b"

# --- fixed values: rule tuples ------------------------------------------------------
RULE_TUPLES = [
    ("dokternya", "ramah", "positive", "Staff Attitude"),
    ("dokter", "baik", "positive", "Staff Attitude"),
    ("antreannya", "lama", "negative", "Waiting Time"),
    ("antrean", "panjang", "negative", "Waiting Time"),
    ("kopinya", "enak", "positive", "Beverage Quality"),
    ("kopi", "pahit", "negative", "Beverage Quality"),
    ("makanan", "lezat", "positive", "Food Quality"),
    ("makanan", "dingin", "negative", "Food Quality"),
    ("pelayanan", "cepat", "positive", "Service Speed"),
    ("pelayanan", "buruk", "negative", "Service Quality"),
    ("tempatnya", "bersih", "positive", "Cleanliness"),
    ("tempat", "nyaman", "positive", "Ambience"),
    ("harga", "murah", "positive", "Price & Value"),
    ("harga", "mahal", "negative", "Price & Value"),
    ("parkiran", "luas", "positive", "Parking"),
    ("fasilitas", "lengkap", "positive", "Facilities"),
]
RULE_NEGATIONS = ["tidak ", "gak ", "kurang ", "bukan "]
RULE_POSITIVE_WORDS = ["enak", "bagus", "ramah", "bersih", "suka"]

# --- fixed values: taxonomy rules -----------------------------------------------------
ALL_TAXONOMY_RULES = [
    ("generic.overall_experience", "generic", "Overall Experience", ["overall", "pengalaman", "experience", "kesan", "puas", "kecewa", "worth", "sepadan", "recommended", "direkomendasikan", "balik lagi", "datang lagi"]),
    ("generic.service_quality", "generic", "Service Quality", ["pelayanan", "layanan", "service", "petugas", "pegawai", "staf", "staff", "helpful", "ramah", "jutek", "responsif", "tidak responsif"]),
    ("generic.service_speed", "generic", "Service Speed", ["cepat", "lambat", "lama", "gercep", "satset", "waktu layanan", "service time", "proses cepat", "proses lama"]),
    ("generic.waiting_time", "generic", "Waiting Time", ["antre", "antrean", "menunggu", "nunggu", "queue", "waiting time", "nomor antrean", "waktu tunggu"]),
    ("generic.staff_attitude", "generic", "Staff Attitude", ["ramah", "jutek", "judes", "ketus", "sopan", "tidak sopan", "cuek", "membantu", "helpful", "informatif", "responsif"]),
    ("generic.cleanliness", "generic", "Cleanliness", ["bersih", "kotor", "jorok", "kebersihan", "sampah", "bau", "pesing", "berdebu"]),
    ("generic.comfort", "generic", "Comfort", ["nyaman", "tidak nyaman", "panas", "dingin", "adem", "sejuk", "bising", "berisik", "tenang"]),
    ("generic.price_value", "generic", "Price & Value", ["harga", "mahal", "murah", "terjangkau", "overpriced", "sepadan", "worth", "value for money", "biaya", "tarif", "fee"]),
    ("generic.location_access", "generic", "Location & Access", ["lokasi", "akses", "jalan", "strategis", "mudah dicari", "susah dicari", "nyasar", "maps"]),
    ("generic.parking", "generic", "Parking", ["parkir", "area parkir", "parking", "valet", "motor", "mobil", "slot parkir"]),
    ("generic.facilities", "generic", "Facilities", ["fasilitas", "toilet", "wifi", "musala", "mushola", "ac", "lift", "eskalator", "ruang tunggu", "kursi", "charging", "stop kontak", "cctv"]),
    ("generic.security", "generic", "Security", ["aman", "tidak aman", "security", "satpam", "petugas keamanan", "cctv", "penjaga"]),
    ("generic.operating_hours", "generic", "Operating Hours", ["jam buka", "jam tutup", "jam operasional", "buka", "tutup", "24 jam", "opening hours"]),
    ("generic.digital_service", "generic", "Digital Service", ["aplikasi", "website", "sistem", "online", "login", "otp", "error", "down", "loading", "notifikasi", "registrasi online", "pendaftaran online"]),
    ("generic.communication_channel", "generic", "Communication Channel", ["whatsapp", "wa", "telepon", "call center", "hotline", "chat", "email", "dm", "dibalas", "tidak dibalas"]),
    ("fnb.food_quality", "food_beverage", "Food Quality", ["makanan", "menu", "nasi", "mie", "pasta", "roti", "croissant", "dessert", "kue", "snack", "cemilan", "cassava", "casava", "steak", "ayam", "burger", "pizza"]),
    ("fnb.beverage_quality", "food_beverage", "Beverage Quality", ["minuman", "kopi", "americano", "latte", "espresso", "cappuccino", "matcha", "teh", "jus", "juice", "milkshake", "mocktail"]),
    ("fnb.taste", "food_beverage", "Taste", ["rasa", "enak", "tidak enak", "asin", "keasinan", "manis", "kemanisan", "pahit", "hambar", "gurih", "pedas", "asam"]),
    ("fnb.portion", "food_beverage", "Portion", ["porsi", "portion", "banyak", "sedikit", "dikit", "kecil", "besar"]),
    ("fnb.presentation", "food_beverage", "Food Presentation", ["penyajian", "plating", "presentasi makanan", "tampilan makanan"]),
    ("fnb.menu_variety", "food_beverage", "Menu Variety", ["variasi menu", "pilihan menu", "menu lengkap", "menu sedikit", "banyak pilihan"]),
    ("fnb.order_accuracy", "food_beverage", "Order Accuracy", ["pesanan salah", "order salah", "salah pesanan", "pesanan sesuai", "order sesuai", "kurang item", "item kurang"]),
    ("fnb.order_speed", "food_beverage", "Order Speed", ["pesanan lama", "makanan lama", "minuman lama", "keluar lama", "nunggu makanan", "nunggu minuman", "service time"]),
    ("fnb.cashier", "food_beverage", "Cashier", ["kasir", "cashier"]),
    ("fnb.barista", "food_beverage", "Barista", ["barista"]),
    ("fnb.waiter", "food_beverage", "Waiter / Server", ["waiter", "waitress", "pramusaji", "pelayan"]),
    ("fnb.ambience", "food_beverage", "Ambience", ["suasana", "ambience", "vibes", "cozy", "nyaman", "estetis", "instagrammable", "outdoor", "indoor", "pohon", "rindang", "adem"]),
    ("fnb.wfc_support", "food_beverage", "Work From Cafe Support", ["wfc", "work from cafe", "wifi", "stop kontak", "colokan", "meja kerja", "laptop"]),
    ("healthcare.medical_service", "healthcare", "Medical Service", ["dokter", "perawat", "bidan", "tenaga kesehatan", "pelayanan medis", "pemeriksaan", "diagnosis", "diagnosa", "tindakan"]),
    ("healthcare.doctor", "healthcare", "Doctor", ["dokter", "dr ", "dr.", "drg", "dokter gigi"]),
    ("healthcare.nurse", "healthcare", "Nurse", ["perawat", "suster", "nurse"]),
    ("healthcare.registration", "healthcare", "Registration", ["pendaftaran", "registrasi", "admisi", "daftar online", "pendaftaran online"]),
    ("healthcare.queue", "healthcare", "Healthcare Queue", ["antrean dokter", "nomor antrean", "nunggu dokter", "waktu tunggu dokter"]),
    ("healthcare.pharmacy", "healthcare", "Pharmacy", ["farmasi", "apotek", "obat", "resep"]),
    ("healthcare.lab", "healthcare", "Laboratory", ["laboratorium", "lab", "cek darah", "tes darah"]),
    ("healthcare.radiology", "healthcare", "Radiology", ["rontgen", "x-ray", "xray", "usg", "radiologi"]),
    ("healthcare.emergency", "healthcare", "Emergency / ER", ["igd", "ugd", "gawat darurat", "emergency"]),
    ("healthcare.bpjs", "healthcare", "BPJS / Insurance Administration", ["bpjs", "jkn", "kis", "rujukan", "jaminan", "asuransi kesehatan"]),
    ("healthcare.inpatient", "healthcare", "Inpatient Care", ["rawat inap", "ranap", "kamar inap"]),
    ("healthcare.outpatient", "healthcare", "Outpatient Care", ["rawat jalan", "rajal", "kontrol", "poliklinik", "poli"]),
    ("government.counter_service", "government", "Counter Service", ["loket", "petugas loket", "counter", "pelayanan loket"]),
    ("government.document_process", "government", "Document Processing", ["dokumen", "berkas", "surat", "akta", "legalisasi", "legalisir", "fotokopi"]),
    ("government.identity_document", "government", "Population Document", ["ktp", "e-ktp", "kartu tanda penduduk", "kartu keluarga", "kk", "akta kelahiran", "dukcapil"]),
    ("government.licensing", "government", "Licensing", ["izin", "perizinan", "izin online", "mpp", "mal pelayanan publik"]),
    ("government.immigration", "government", "Immigration", ["imigrasi", "paspor", "passport", "visa"]),
    ("government.vehicle_document", "government", "Vehicle Document Service", ["samsat", "sim", "stnk", "pajak kendaraan"]),
    ("government.bureaucracy", "government", "Bureaucracy", ["birokrasi", "prosedur", "alur proses", "persyaratan", "syarat"]),
    ("banking.customer_service", "banking", "Customer Service", ["customer service", "cs bank", "layanan pelanggan"]),
    ("banking.teller", "banking", "Teller", ["teller"]),
    ("banking.security", "banking", "Bank Security", ["satpam", "security", "petugas keamanan"]),
    ("banking.account_opening", "banking", "Account Opening", ["buka rekening", "pembukaan rekening", "rekening baru"]),
    ("banking.atm", "banking", "ATM", ["atm", "mesin atm", "tarik tunai", "setor tunai", "atm error", "atm kosong"]),
    ("banking.mobile_banking", "banking", "Mobile Banking", ["mobile banking", "mbanking", "m-banking", "livin", "brimo", "bca mobile", "wondr"]),
    ("banking.internet_banking", "banking", "Internet Banking", ["internet banking", "ibanking", "i-banking"]),
    ("banking.transaction", "banking", "Transaction", ["transfer", "transaksi", "saldo", "pending", "gagal transaksi", "qris"]),
    ("banking.credit_loan", "banking", "Credit / Loan", ["kredit", "pinjaman", "loan", "kpr", "kartu kredit"]),
    ("banking.fee", "banking", "Bank Fee", ["biaya admin", "biaya administrasi", "admin fee", "fee"]),
    ("social.benefit_service", "social_service", "Social Benefit Service", ["bansos", "bantuan sosial", "blt", "bpnt", "pkh", "sembako", "penerima manfaat"]),
    ("social.data_registration", "social_service", "Social Welfare Data", ["dtks", "data sosial", "data penerima", "verifikasi data"]),
    ("social.case_worker", "social_service", "Social Worker / Companion", ["pendamping", "pendamping sosial", "petugas sosial"]),
    ("social.disability_service", "social_service", "Disability Service", ["disabilitas", "difabel", "penyandang disabilitas"]),
    ("social.elderly_service", "social_service", "Elderly Service", ["lansia", "panti lansia", "panti jompo"]),
    ("hotel.room", "hotel", "Room", ["kamar", "room", "kasur", "bed", "handuk", "linen"]),
    ("hotel.cleanliness", "hotel", "Room Cleanliness", ["kamar bersih", "kamar kotor", "housekeeping", "bau kamar"]),
    ("hotel.reception", "hotel", "Reception", ["resepsionis", "receptionist", "reception"]),
    ("hotel.checkin_checkout", "hotel", "Check-in / Check-out", ["check-in", "check-out", "checkin", "checkout"]),
    ("hotel.breakfast", "hotel", "Breakfast", ["sarapan", "breakfast"]),
    ("hotel.pool", "hotel", "Swimming Pool", ["kolam renang", "pool", "swimming pool"]),
    ("retail.product_quality", "retail", "Product Quality", ["produk", "barang", "kualitas produk", "kualitas barang"]),
    ("retail.stock", "retail", "Stock Availability", ["stok", "stock", "habis", "restock", "tersedia"]),
    ("retail.cashier", "retail", "Cashier", ["kasir", "cashier"]),
    ("retail.promotion", "retail", "Promotion / Discount", ["promo", "promosi", "diskon", "discount", "voucher"]),
    ("retail.store_layout", "retail", "Store Layout", ["layout toko", "penataan", "rak", "lorong", "aisle"]),
    ("education.teacher", "education", "Teacher / Lecturer", ["guru", "dosen", "pengajar"]),
    ("education.administration", "education", "Academic Administration", ["tata usaha", "tu", "admin kampus", "administrasi akademik"]),
    ("education.classroom", "education", "Classroom", ["kelas", "ruang kelas", "classroom"]),
    ("education.library", "education", "Library", ["perpustakaan", "perpus", "library"]),
    ("education.lab", "education", "Laboratory", ["laboratorium", "lab komputer", "lab"]),
    ("education.campus_facility", "education", "Campus Facility", ["kantin", "wifi kampus", "toilet kampus", "parkir kampus"]),
    ("transport.station", "transportation", "Station / Terminal", ["stasiun", "terminal", "halte", "station"]),
    ("transport.ticketing", "transportation", "Ticketing", ["tiket", "ticket", "loket tiket", "mesin tiket"]),
    ("transport.schedule", "transportation", "Schedule", ["jadwal", "schedule", "keberangkatan", "kedatangan", "delay", "terlambat"]),
    ("transport.cleanliness", "transportation", "Transport Cleanliness", ["toilet stasiun", "stasiun bersih", "terminal kotor"]),
    ("transport.driver", "transportation", "Driver", ["driver", "pengemudi", "sopir", "supir"]),
    ("automotive.mechanic", "automotive", "Mechanic", ["mekanik", "mechanic"]),
    ("automotive.service_quality", "automotive", "Workshop Service", ["servis mobil", "servis motor", "service mobil", "service motor"]),
    ("automotive.sparepart", "automotive", "Spare Part", ["suku cadang", "sparepart", "onderdil"]),
    ("automotive.carwash", "automotive", "Car Wash", ["cuci mobil", "car wash", "carwash"]),
    ("tourism.scenery", "tourism", "Scenery", ["pemandangan", "view", "scenery", "sunset", "gunung", "danau", "pantai"]),
    ("tourism.photo_spot", "tourism", "Photo Spot", ["spot foto", "instagrammable", "foto", "photo"]),
    ("tourism.family_friendly", "tourism", "Family Friendly", ["ramah keluarga", "family friendly", "ramah anak", "kids friendly"]),
    ("tourism.ticket_price", "tourism", "Ticket Price", ["harga tiket", "tiket masuk", "HTM", "biaya masuk"]),
]
#: The rules used where none are given: the generic group and everyday food heads.
DEFAULT_TAXONOMY_IDS = [
    "generic.overall_experience", "generic.service_quality", "generic.service_speed", "generic.waiting_time", "generic.staff_attitude",
    "generic.cleanliness", "generic.comfort", "generic.price_value", "generic.location_access", "generic.parking", "generic.facilities",
    "fnb.food_quality", "fnb.beverage_quality", "fnb.taste", "fnb.ambience", "healthcare.doctor",
]
TAXONOMY_RULES = [rule for rule in ALL_TAXONOMY_RULES if rule[0] in DEFAULT_TAXONOMY_IDS]
TAXONOMY_ALIASES = {
    "ambience": "fnb.ambience", "food quality": "fnb.food_quality", "beverage quality": "fnb.beverage_quality",
    "taste": "fnb.taste", "portion": "fnb.portion", "menu variety": "fnb.menu_variety",
    "cashier": "fnb.cashier", "barista": "fnb.barista", "service quality": "generic.service_quality",
    "service speed": "generic.service_speed", "waiting time": "generic.waiting_time",
    "staff attitude": "generic.staff_attitude", "price & value": "generic.price_value",
    "price and value": "generic.price_value", "parking": "generic.parking", "facilities": "generic.facilities",
    "toilet": "generic.facilities", "prayer room": "generic.prayer_room",
    "prayer room / facilities": "generic.prayer_room", "overall experience": "generic.overall_experience",
    "doctor service": "healthcare.doctor", "doctor": "healthcare.doctor", "nurse service": "healthcare.nurse",
    "nurse": "healthcare.nurse", "registration": "healthcare.registration",
    "queue / waiting time": "healthcare.queue", "healthcare queue": "healthcare.queue",
    "pharmacy": "healthcare.pharmacy", "laboratory": "healthcare.lab", "radiology": "healthcare.radiology",
    "emergency service": "healthcare.emergency", "bpjs service": "healthcare.bpjs",
}
CATEGORY_KEYWORDS = {
    "fuel": ["bensin", "bbm", "bahan bakar", "fuel", "irit", "boros"],
    "machine": ["mesin", "engine", "transmisi", "tenaga mesin"],
    "others": ["mobil", "kendaraan", "overall"],
    "part": ["part", "suku cadang", "sparepart", "komponen", "ban", "rem", "suspensi"],
    "price": ["harga", "mahal", "murah", "price"],
    "service": ["service", "servis", "dealer", "bengkel", "pelayanan"],
    "ac": ["ac", "air conditioner", "pendingin"],
    "air_panas": ["air panas", "hot water"],
    "bau": ["bau", "aroma"],
    "general": ["hotel", "penginapan", "overall"],
    "kebersihan": ["bersih", "kotor", "kebersihan"],
    "linen": ["linen", "sprei", "seprai", "selimut", "handuk"],
    "sunrise_meal": ["sarapan", "breakfast", "makan sahur", "sahur"],
    "tv": ["tv", "televisi"],
    "wifi": ["wifi", "wi-fi", "internet"],
    "food_and_beverages": ["makanan", "minuman", "food", "beverage", "kopi", "menu"],
    "food_beverage": ["makanan", "minuman", "food", "beverage", "kopi", "menu"],
    "ambience": ["suasana", "ambience", "vibes", "tempat", "outdoor", "indoor"],
    "location": ["lokasi", "location", "akses"],
    "cleanliness": ["bersih", "kotor", "kebersihan", "cleanliness"],
    "room_facilities": ["kamar", "room", "fasilitas kamar"],
    "public_facilities": ["fasilitas", "toilet", "parkir", "kolam", "lift"],
    "service_staff": ["pelayanan", "service", "staff", "staf", "petugas"],
    "price_value": ["harga", "price", "value", "mahal", "murah"],
}
SOURCE_CATEGORY_RULES = [
    ("raw", r"\b(waiting time|queue|antrean|antrian|waiting)\b", "Waiting Time"),
    ("raw", r"\b(service speed|order speed|speed)\b", "Service Speed"),
    ("raw", r"\b(professionalism|professional|explanation quality|penjelasan)\b", "Professionalism"),
    ("both", r"\b(price|harga|value|biaya|cost)\b", "Price & Value"),
    ("raw", r"\b(staff attitude|cashier|barista|pegawai|petugas|staff|employee|kasir|dokter|doctor|perawat|nurse|midwife|bidan)\b", "Staff Attitude"),
    ("both", r"\b(parking|parkir)\b", "Parking"),
    ("both", r"\b(location|lokasi|access|akses|accessibility|strategis|jalan)\b", "Location & Access"),
    ("raw", r"\b(clean|cleanliness|kebersihan|bersih|kotor)\b", "Cleanliness"),
    ("both", r"\b(portion|porsi)\b", "Portion"),
    ("raw", r"\b(menu variety|variety|pilihan menu)\b", "Menu Variety"),
    ("both", r"\b(wifi|digital|app|aplikasi|website|internet|qr|online)\b", "Digital Service"),
    ("both", r"\b(ambience|suasana|vibes|environment|atmosphere)\b", "Ambience"),
    ("both", r"\b(toilet|prayer room|waiting room|facilit|fasilitas|musholla|mushola|ac|lift|kursi|meja|security)\b", "Facilities"),
    ("raw", r"\b(service|pelayanan|process|administrative|administrasi|information clarity|appointment|scheduling|registration|pharmacy|medication|emergency|referral|laboratory|radiology|bpjs|availability|cashier payment)\b", "Service Quality"),
    ("both", r"\b(beverage|drink|minuman|coffee|kopi|americano|latte|tea|teh)\b", "Beverage Quality"),
    ("both", r"\b(food|makanan|meal|dish|pasta|nasi|taste|rasa)\b", "Food Quality"),
    ("raw", r"\b(product quality|quality)\b", "Other"),
    ("raw", r"\b(overall|general|experience|pengalaman)\b", "Overall Experience"),
]
FALLBACK_CATEGORY_RULES = [
    ("aspect", ["makanan", "rasa", "menu", "nasi", "ayam", "kopi", "teh", "minuman", "juices"], ["kopi", "teh", "jus", "minuman", "es"], "Beverage Quality", "Food Quality"),
    ("aspect", ["dokter", "pelayanan", "staf", "pegawai", "kasir", "waiter", "suster"], ["ramah", "sopan", "jutek", "sikap", "senyum"], "Staff Attitude", "Service Quality"),
    ("both", ["antrean", "antri", "nunggu", "lama", "cepat"], [], None, "Waiting Time"),
    ("both", ["harga", "murah", "mahal", "bayar", "biaya"], [], None, "Price & Value"),
    ("both", ["bersih", "kotor", "bau", "rapi", "higienis"], [], None, "Cleanliness"),
    ("both", ["parkir", "parkiran", "tukang parkir"], [], None, "Parking"),
    ("both", ["suasana", "tempat", "vibes", "ambience", "view", "pemandangan"], [], None, "Ambience"),
    ("both", ["porsi", "banyak", "dikit", "sedikit"], [], None, "Portion"),
    ("both", ["wifi", "toilet", "ac", "fasilitas", "meja", "kursi"], [], None, "Facilities"),
    ("both", ["lokasi", "akses", "jalan", "strategis"], [], None, "Location & Access"),
]
PRICE_HEAD = r"^\s*(harga|biaya|tarif|price)\b"
PRAYER_HEAD = r"\b(musholla|mushola|musala|masjid|prayer\s*room)\b"
WAIT_EVIDENCE = r"\b(lama+|nunggu|menunggu|terlambat|delay|hampir\s+\d+|\d+\s*(?:mnt|menit|jam))\b"
WAIT_GUARD = r"\b(lama+|hampir\s+\d+|\d+\s*(?:mnt|menit|jam)|nunggu|menunggu)\b"
SERVICE_ASPECT = r"\b(service|servis|pelayanan|pesanan|order|minuman|makanan|antrean|antrian)\b"
LATENESS_WORDS = ["lama", "nunggu", "menunggu", "antrean", "antrian"]

# --- fixed values: augmentation ---------------------------------------------------------
CONTRAST_PAIRS = [
    ("kopi", "enak", "positive", "pasta", "keasinan", "negative", "food_beverage"),
    ("makanan", "enak", "positive", "pelayanan", "lama", "negative", "food_beverage"),
    ("tempat", "nyaman", "positive", "toilet", "kotor", "negative", "food_beverage"),
    ("dokter", "ramah", "positive", "antrean", "lama", "negative", "healthcare"),
    ("perawat", "membantu", "positive", "administrasi", "lambat", "negative", "healthcare"),
    ("petugas", "ramah", "positive", "proses ktp", "lama", "negative", "government"),
    ("teller", "ramah", "positive", "antrean", "lama", "negative", "banking"),
    ("kamar", "bersih", "positive", "ac", "kurang dingin", "negative", "hotel"),
    ("produk", "bagus", "positive", "harga", "mahal", "negative", "retail"),
    ("guru", "ramah", "positive", "administrasi", "lambat", "negative", "education"),
]
CONTRAST_CONNECTORS = [" tapi ", " tetapi ", " namun "]
NEUTRAL_TEMPLATES = [
    ("harga", "harganya standar", "generic"), ("lokasi", "lokasinya di lantai dua", "generic"),
    ("parkir", "tersedia area parkir", "generic"),
    ("jam operasional", "tempat ini buka sampai jam 10", "generic"),
    ("americano", "saya memesan americano", "food_beverage"),
    ("loket", "tersedia tiga loket pelayanan", "government"),
    ("dokter", "dokternya bertugas pada hari senin", "healthcare"),
    ("atm", "atm berada di dekat pintu masuk", "banking"),
    ("kelas", "kelas berada di lantai dua", "education"),
    ("kamar", "kamar nomor 205 berada di lantai dua", "hotel"),
]

# --- fixed values: thresholds, weights and targets -----------------------------------------
PROFILES = [
    ("scientific_balanced", 0.70, 0.55, False, False),
    ("production_precision", 0.90, 0.90, False, False),
    ("maps_high_recall", 0.10, 0.55, True, True),
]
SILVER_REVIEW_CONF = 0.90
SILVER_ANNOTATION_CONF = 0.90
PLACE_SPLIT_RATIOS = (0.70, 0.15)
RESEARCH_TARGETS = {
    "sentiment_macro_f1": 0.80, "positive_f1": 0.90, "negative_f1": 0.84, "neutral_f1": 0.68,
    "aspect_exact_f1": 0.74, "aspect_sentiment_f1": 0.68, "relation_macro_f1": 0.75,
    "relation_balanced_accuracy": 0.75, "macro_domain_f1": 0.72, "worst_domain_f1": 0.62,
}
PRODUCTION_TARGETS = {
    "aspect_exact_f1": 0.80, "opinion_exact_f1": 0.85, "relation_macro_f1": 0.80,
    "relation_negative_recall": 0.75, "relation_positive_recall": 0.75, "positive_f1": 0.85,
    "negative_f1": 0.85, "neutral_f1": 0.65, "triplet_exact_f1": 0.75, "negative_triplet_recall": 0.85,
    "auto_precision": 0.90, "auto_coverage": 0.70,
}
CHECKPOINT_WEIGHTS = {"macro_f1": 0.45, "neutral_f1": 0.30, "negative_f1": 0.20, "positive_f1": 0.05}

# --- fixed values: administrative regions -----------------------------------------------------
PROVINCES = [
    ("11", "Aceh", ["aceh"]), ("12", "Sumatera Utara", ["sumut"]), ("13", "Sumatera Barat", ["sumbar"]),
    ("14", "Riau", []), ("15", "Jambi", []), ("16", "Sumatera Selatan", ["sumsel"]), ("17", "Bengkulu", []),
    ("18", "Lampung", []), ("19", "Kepulauan Bangka Belitung", ["babel"]), ("21", "Kepulauan Riau", ["kepri"]),
    ("31", "DKI Jakarta", ["jakarta", "dki"]), ("32", "Jawa Barat", ["jabar"]), ("33", "Jawa Tengah", ["jateng"]),
    ("34", "DI Yogyakarta", ["diy", "yogyakarta"]), ("35", "Jawa Timur", ["jatim"]), ("36", "Banten", []),
    ("51", "Bali", []), ("52", "Nusa Tenggara Barat", ["ntb"]), ("53", "Nusa Tenggara Timur", ["ntt"]),
    ("61", "Kalimantan Barat", ["kalbar"]), ("62", "Kalimantan Tengah", ["kalteng"]),
    ("63", "Kalimantan Selatan", ["kalsel"]), ("64", "Kalimantan Timur", ["kaltim"]),
    ("65", "Kalimantan Utara", ["kaltara"]), ("71", "Sulawesi Utara", ["sulut"]),
    ("72", "Sulawesi Tengah", ["sulteng"]), ("73", "Sulawesi Selatan", ["sulsel"]),
    ("74", "Sulawesi Tenggara", ["sultra"]), ("75", "Gorontalo", []), ("76", "Sulawesi Barat", ["sulbar"]),
    ("81", "Maluku", []), ("82", "Maluku Utara", ["malut"]), ("91", "Papua", []), ("92", "Papua Barat", []),
    ("93", "Papua Selatan", []), ("94", "Papua Tengah", []), ("95", "Papua Pegunungan", []),
    ("96", "Papua Barat Daya", []),
]
REGIONS = [
    ("31.71", "Kota Administrasi Jakarta Selatan", "city", "DKI Jakarta", ["jakarta selatan", "jaksel"]),
    ("31.72", "Kota Administrasi Jakarta Timur", "city", "DKI Jakarta", ["jakarta timur", "jaktim"]),
    ("31.73", "Kota Administrasi Jakarta Pusat", "city", "DKI Jakarta", ["jakarta pusat", "jakpus"]),
    ("31.74", "Kota Administrasi Jakarta Barat", "city", "DKI Jakarta", ["jakarta barat", "jakbar"]),
    ("31.75", "Kota Administrasi Jakarta Utara", "city", "DKI Jakarta", ["jakarta utara", "jakut"]),
    ("32.04", "Kabupaten Bandung", "regency", "Jawa Barat", ["bandung", "kabupaten bandung", "kab bandung"]),
    ("32.17", "Kabupaten Bandung Barat", "regency", "Jawa Barat", ["bandung barat", "kabupaten bandung barat", "kab bandung barat"]),
    ("32.73", "Kota Bandung", "city", "Jawa Barat", ["bandung", "kota bandung", "bdg"]),
    ("32.71", "Kota Bogor", "city", "Jawa Barat", ["bogor", "kota bogor"]),
    ("32.75", "Kota Bekasi", "city", "Jawa Barat", ["bekasi", "kota bekasi"]),
    ("32.77", "Kota Cimahi", "city", "Jawa Barat", ["cimahi"]),
    ("33.72", "Kota Surakarta", "city", "Jawa Tengah", ["surakarta", "solo", "kota solo"]),
    ("33.74", "Kota Semarang", "city", "Jawa Tengah", ["semarang", "kota semarang"]),
    ("33.28", "Kabupaten Tegal", "regency", "Jawa Tengah", ["kabupaten tegal", "kab tegal"]),
    ("33.76", "Kota Tegal", "city", "Jawa Tengah", ["tegal", "kota tegal"]),
    ("34.71", "Kota Yogyakarta", "city", "DI Yogyakarta", ["yogyakarta", "jogja", "jogjakarta", "kota yogyakarta"]),
    ("35.07", "Kabupaten Malang", "regency", "Jawa Timur", ["malang", "kabupaten malang", "kab malang"]),
    ("35.73", "Kota Malang", "city", "Jawa Timur", ["malang", "kota malang"]),
    ("35.78", "Kota Surabaya", "city", "Jawa Timur", ["surabaya", "sby", "kota surabaya"]),
    ("35.79", "Kota Batu", "city", "Jawa Timur", ["batu", "kota batu"]),
    ("35.71", "Kota Kediri", "city", "Jawa Timur", ["kediri", "kota kediri"]),
    ("36.04", "Kabupaten Serang", "regency", "Banten", ["serang", "kabupaten serang", "kab serang"]),
    ("36.73", "Kota Serang", "city", "Banten", ["serang", "kota serang"]),
    ("51.71", "Kota Denpasar", "city", "Bali", ["denpasar"]),
    ("12.71", "Kota Medan", "city", "Sumatera Utara", ["medan"]),
    ("13.71", "Kota Padang", "city", "Sumatera Barat", ["padang", "kota padang"]),
    ("14.71", "Kota Pekanbaru", "city", "Riau", ["pekanbaru"]),
    ("16.71", "Kota Palembang", "city", "Sumatera Selatan", ["palembang"]),
    ("18.71", "Kota Bandar Lampung", "city", "Lampung", ["bandar lampung"]),
    ("61.71", "Kota Pontianak", "city", "Kalimantan Barat", ["pontianak"]),
    ("63.71", "Kota Banjarmasin", "city", "Kalimantan Selatan", ["banjarmasin"]),
    ("64.71", "Kota Balikpapan", "city", "Kalimantan Timur", ["balikpapan"]),
    ("64.72", "Kota Samarinda", "city", "Kalimantan Timur", ["samarinda"]),
    ("73.71", "Kota Makassar", "city", "Sulawesi Selatan", ["makassar", "ujung pandang"]),
    ("71.71", "Kota Manado", "city", "Sulawesi Utara", ["manado"]),
    ("81.71", "Kota Ambon", "city", "Maluku", ["ambon"]),
    ("91.71", "Kota Jayapura", "city", "Papua", ["jayapura"]),
]
LOCATION_CUE = (
    r"(?:\b(?:di|dari|ke|menuju|asal|domisili|alamat|daerah|wilayah|cabang|outlet)\s+|"
    r"\b(?:berasal|tinggal|dikirim|pengiriman)\s+(?:dari|di|ke)\s+)$"
)
NOT_A_PLACE = [
    r"\b(?:sangat|amat|begitu|nasibnya)\s+malang\b",
    r"\b(?:melempar|seperti|keras seperti)\s+batu\b",
    r"\b(?:bekerja|bermain|tampil)\s+solo\b",
]
CUSTOMER_LABEL = r"(?Ui)(?<![\w])(customer(?:_id)?|cust(?:omer)?\s*id|no|id)\s*[:#-]?\s*(\d+)(?!\w)"


def literal_map(values: Mapping[str, str]):
    """A small lookup as a map literal: evaluated inside the row, no join."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def load_pairs(spark: SparkSession, path: str) -> dict[str, str]:
    """A deployment's own ``token,replacement`` CSV, bounded and checked before use."""
    rows = spark.read.schema("token string, replacement string").csv(path, header=True)
    if rows.limit(50_001).count() > 50_000:
        raise ValueError("a literal lexicon is limited to 50,000 rows; join larger tables instead")
    return {r["token"]: r["replacement"] for r in rows.collect()}


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    """taxonomy_id, domain, label, position, keywords; from rows or the defaults."""
    rows = [(t, d, l, i, list(k)) for i, (t, d, l, k) in enumerate(rules or TAXONOMY_RULES)]
    return spark.createDataFrame(rows, "taxonomy_id string, domain string, label string, position int, keywords array<string>")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A deployment's own taxonomy as JSON lines with the columns of ``rules_frame``."""
    return spark.read.schema(
        "taxonomy_id string, domain string, label string, position int, keywords array<string>"
    ).json(path)


def region_dims(spark: SparkSession, provinces=None, regions=None) -> tuple[DataFrame, DataFrame]:
    """(region_alias, province_alias) dimension tables from nested region rows."""
    from reviewspark.functions.text import location_key

    provinces = provinces or PROVINCES
    regions = regions or REGIONS
    p = spark.createDataFrame([(n, [n, *a]) for _, n, a in provinces], "province string, names array<string>")
    r = spark.createDataFrame(
        [(c, n, t, p_, [n, *a]) for c, n, t, p_, a in regions],
        "code string, name string, location_type string, province string, names array<string>",
    )
    province_alias = p.select("province", F.explode("names").alias("raw")).select(location_key(F.col("raw")).alias("alias"), "province").distinct()
    region_alias = r.select("code", "name", "location_type", "province", F.explode("names").alias("raw")).select(
        location_key(F.col("raw")).alias("alias"), "code", "name", "location_type", "province"
    ).distinct()
    return region_alias, province_alias

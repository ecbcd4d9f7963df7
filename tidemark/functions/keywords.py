"""Word lists of the question rules.

They must equal the lists that the rules are defined by, in this order.
"""

LANGUAGE_WORDS = ("apa", "bagaimana", "berapa", "kenapa", "mengapa", "yang", "dengan", "untuk", "dari", "tolong", "bisa",
                  "saya", "kamu", "tidak", "sudah", "belum", "dan", "atau", "ini", "itu")
GREETINGS = ("h(a|e)llo", "hai", "hi", "hey", "halo", "selamat (pagi|siang|sore|malam)",
             "good (morning|afternoon|evening)", "assalamu'?alaikum", "apa kabar", "how are you")
THANKS = ("th(anks?|ank you)", "makasih", "terima kasih", "thx", "mantap", "keren", "great,? thanks")

PREDICTION_WORDS = ("prediksi", "proyeksi", "forecast", "revenue", "churn", "risiko", "bulan depan", "minggu depan")
INSIGHT_WORDS = ("kenapa", "mengapa", "strategi", "sebaiknya", "rekomendasi", "artinya", "why", "should")
FACT_WORDS = ("berapa", "jumlah", "total", "how many", "daftar")
FORECAST_WORDS = ("proyeksi", "prediksi", "forecast", "ramalan", "ke depan", "kedepan", "mendatang", "next week",
                  "next month", "upcoming")
REVENUE_WORDS = ("revenue", "pendapatan", "omzet", "penjualan", "income")
NOT_FORECASTABLE_WORDS = ("conversion", "konversi", "channel", "kanal", "kampanye", "campaign", "cpa", "agen", "agent",
                          "segmentasi", "segment")
EXPLORATORY_WORDS = ("tren", "trend", "sebaran", "distribusi", "distribution", "komposisi", "pola", "eksplorasi",
                     "kualitas data", "gambaran umum", "overview", "bulanan", "per bulan", "monthly", "tabel", "table",
                     "rincian", "breakdown", "mingguan", "per minggu")
COMPARISON_WORDS = ("bandingkan", "dibanding", "dibandingkan", "perbandingan", "versus", " vs ", "sebelumnya",
                    "periode sebelum", "compare", "comparison", "selisih", "pertumbuhan", "growth", "naik atau turun",
                    "lebih tinggi", "lebih rendah")

MONTHS = {"januari": 1, "january": 1, "februari": 2, "february": 2, "maret": 3, "march": 3, "april": 4, "mei": 5, "may": 5,
          "juni": 6, "june": 6, "juli": 7, "july": 7, "agustus": 8, "august": 8, "september": 9, "oktober": 10,
          "october": 10, "november": 11, "desember": 12, "december": 12}

TOP_N = r"\btop\s*(\d{1,2})\b|\b(\d{1,2})\s*(?:teratas|terbaik|terpopuler|terlaris)\b"
NAME_AFTER_CUE = r"(?:bernama|nama(?:nya)?|customer|pelanggan)\s+([A-Z][a-zA-Z']+(?:\s+[A-Z][a-zA-Z']+)?)"

# Dashboard query -> keywords.
METRIC_WORDS = {
    "revenue_current": ("revenue hari ini", "revenue sekarang", "ringkasan revenue"),
    "revenue_by_period": ("tren revenue", "revenue per bulan", "revenue per minggu"),
    "revenue_daily": ("revenue harian", "revenue per hari"),
    "revenue_by_destination": ("revenue destinasi", "destinasi terlaris"),
    "revenue_by_package_type": ("tipe paket", "revenue paket"),
    "revenue_by_channel": ("kanal", "channel", "revenue kanal"),
    "revenue_by_payment_method": ("metode pembayaran", "payment method"),
    "revenue_by_segment": ("revenue segmen", "segmen pelanggan"),
    "agent_performance": ("agen", "agent", "target agen"),
    "customer_type_revenue": ("pelanggan baru", "repeat", "customer type"),
    "discount_impact": ("diskon", "discount", "potongan harga"),
    "payment_status_summary": ("status pembayaran", "belum bayar", "refund"),
    "customer_segment_distribution": ("distribusi segmen", "komposisi segmen"),
    "customer_age_distribution": ("usia", "umur", "age group"),
    "customer_city_distribution": ("kota", "city", "asal pelanggan"),
    "customer_acquisition_channel": ("akuisisi", "acquisition channel"),
    "customer_top_spenders": ("pelanggan terbaik", "top customer", "belanja tertinggi"),
    "customer_new_by_day": ("pelanggan baru per hari", "pertumbuhan pelanggan"),
    "customer_repeat_ratio": ("rasio repeat", "loyalitas"),
    "booking_status_summary": ("status booking", "booking selesai", "booking batal"),
    "booking_volume": ("volume booking", "jumlah booking"),
    "booking_lead_time": ("lead time", "jarak pesan"),
    "booking_cancellation_rate": ("pembatalan", "cancel", "batal"),
    "booking_payment_gateway": ("payment gateway", "gerbang pembayaran"),
    "campaign_performance": ("kampanye", "campaign", "cpa"),
    "campaign_type_summary": ("tipe kampanye", "jenis kampanye"),
    "campaign_funnel": ("funnel", "konversi kampanye"),
    "destination_popularity": ("popularitas destinasi", "destinasi populer"),
    "destination_region_summary": ("wilayah", "region", "provinsi"),
    "review_sentiment_summary": ("sentimen", "ulasan", "review"),
    "review_rating_trend": ("tren rating", "rating per bulan"),
    "review_destination_rating": ("rating destinasi", "destinasi terbaik"),
    "partner_top_hotels": ("hotel", "penginapan"),
    "partner_top_flight_routes": ("penerbangan", "rute", "flight"),
    "package_top_packages": ("paket terlaris", "top package"),
    "package_type_summary": ("ringkasan paket", "jenis paket"),
    "customer_search": ("cari pelanggan", "siapa pelanggan"),
    "customer_churn_risk": ("pelanggan berisiko", "siapa yang akan churn", "risiko tinggi"),
}

# Topic -> keywords.
TOPIC_WORDS = {
    "overview": ("ringkasan", "overview", "dashboard utama", "halaman depan", "ikhtisar"),
    "revenue_trend": ("tren revenue", "revenue bulanan", "grafik revenue", "pertumbuhan revenue"),
    "revenue_destination": ("revenue destinasi", "destinasi terlaris", "per destinasi"),
    "revenue_channel": ("kanal", "channel", "revenue kanal"),
    "revenue_segment": ("revenue segmen", "segmen pelanggan"),
    "revenue_discount": ("diskon", "discount", "potongan"),
    "agent_performance": ("agen", "agent", "kinerja agen", "target agen"),
    "bookings": ("booking", "pesanan", "volume booking"),
    "booking_cancellation": ("pembatalan", "cancel", "batal"),
    "customers": ("pelanggan", "customer", "segmentasi pelanggan"),
    "customer_top": ("pelanggan terbaik", "top customer", "belanja tertinggi"),
    "churn": ("churn", "risiko pelanggan", "retensi"),
    "forecast": ("forecast", "proyeksi", "prediksi revenue", "ramalan"),
    "campaigns": ("kampanye", "campaign", "cpa", "iklan"),
    "destinations": ("destinasi", "destination", "wilayah"),
    "packages": ("paket", "package", "paket terlaris"),
    "partners": ("hotel", "penerbangan", "mitra", "partner"),
    "reviews": ("ulasan", "review", "sentimen", "rating"),
}

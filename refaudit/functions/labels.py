"""Reader-facing labels. Reports and filters depend on the exact wording."""

STATUS_TEXT = {"verified": "Doğrulandı", "review": "İnceleme gerekli", "failed": "Bulunamadı", "error": "Kontrol tamamlanamadı"}
WEB_STATE_TEXT = {
    "deferred": "Web kotası nedeniyle ertelendi", "blocked": "Web erişimi engellendi",
    "missing": "Web bağlantısı bulunamadı", "unsupported": "Web türü desteklenmiyor"}
WEB_ERROR_TEXT = "Web kontrolü tamamlanamadı"
WEB_STALE_TEXT = "Web erişimi engellendi; önceki künye kullanıldı"
WEB_VERIFIED_TEXT = "Web künyesi doğrulandı"
WEB_REVIEW_TEXT = "Web künyesi incelenmeli"
WEB_PARTIAL_TEXT = "Web künyesi kısmen doğrulandı"

CHANGE_YEAR, CHANGE_DOI_OTHER, CHANGE_DOI_FOUND = "Yıl", "DOI farklı", "DOI bulundu"
CHANGE_TITLE, CHANGE_FORMATTED = "Başlık farklı", "Künye biçimlendirildi"
REASON_VERIFIED = "Başlık, yazar ve mevcut kimlik bilgileri tutarlı bir kayıtla eşleşti."
REASON_REVIEW_SUFFIX = ". Öneri inceleme için gösterildi; özgün kaynak değiştirilmedi."
REASON_AUTHOR = "İlk yazar eşleşmesi kesinleşmedi"
REASON_DOI = "Verilen DOI ile bulunan kaydın DOI’si farklı"
REASON_TITLE = "Başlık eşleşmesi yeterince güçlü değil"
REASON_BOOK = "Kitap baskısı, yayın yılı ve yayınevi bilgilerini kontrol edin"
REASON_ARCHIVE = "Arşiv kaydının künye bilgilerini kontrol edin"
REASON_FAILED = "Yeterince güçlü bir akademik eşleşme bulunamadı. Kaynak özgün haliyle korundu."
REASON_UNPARSED = "Başlık ayrıştırılamadı ve yeterli eşleşme bulunamadı. Kaynağın yazımını kontrol edin."
REASON_ERROR_SUFFIX = ". Kaynak özgün haliyle korundu; tekrar deneyebilirsiniz."
REASON_PRIMARY_DOWN = ". Crossref geçici olarak erişilemiyor; ek kaynak sorguları bu nedenle başlatılmadı. Kaynak özgün haliyle korundu; tekrar deneyebilirsiniz."
SERVICE_ERROR = "Servis hatası"

ISSUE_AMBIGUOUS = "Belirsiz eşleşme: aynı yazar ve yıl için birden fazla kayıt."
ISSUE_YEAR = "Yıl uyuşmazlığı"
ISSUE_YEAR_MANY = "Yıl eşleşmiyor; birden fazla yayın adayı var."
ISSUE_FUZZY = "Olası yazar yazım uyuşmazlığı; yayın kimliğini kontrol edin."
ISSUE_ORPHAN = "Kaynakçası olmayan atıf"
ISSUE_GROUP = "Yazar grubu uyuşmazlığı; eşleşmeyi kontrol edin."
ISSUE_PROTECTED = "Alan kodu/korunan öğe: yalnız raporlama."
ISSUE_MANUAL = "Seçtiğiniz kaynakla yazar/yıl uyuşmazlığı"
ISSUE_MANUAL_PROTECTED = "Korunan alan; yalnız raporlama."
YEAR_REVIEW_REASON = "Aynı yazar farklı bir yayına veya ön baskıya ait olabilir. Yayın sürümünü seçip eşleşmeyi kabul edin."
FINDING_ORPHAN_REFERENCE = "Taranan metinde atıfı bulunmayan kaynak"
FINDING_DUPLICATE = "Yinelenen kaynakça kaydı"
LOCATION_MAIN, LOCATION_FOOTNOTE, LOCATION_ENDNOTE = "Ana metin", "Dipnot", "Sonnot"

VERDICT_EXPLANATION = {
    "supported": "Bütün iddialar doğrulanmış pasajlarla desteklendi.",
    "partial": "İddiaların yalnız bir bölümü için geçerli destek bulundu.",
    "contradicted": "En az bir iddia doğrulanmış yayın pasajıyla çelişiyor.",
    "unassessable": "Geçerli kanıt sağlanamadığı için değerlendirme tamamlanamadı.",
    "not_found": "Seçilen pasajlarda destek bulunamadı; tüm yayında yokluk sonucu çıkarılamaz."}
REJECTED_SUFFIX = " iddianın kanıt alıntısı doğrulanamadı."
EVIDENCE_ERROR = "Modelin kanıt alıntısı belirtilen yayın pasajında doğrulanamadı veya alıntı sınırını aştı."
EVIDENCE_UNCERTAIN = "Bazı bölümlerde değerlendirme tamamlanamadı; yayında destek olmadığı sonucuna varılamaz."
EVIDENCE_NONE = "Erişilen yayın metninin kaynakça dışındaki bölümleri tarandı; bu atfa ilişkin destek bulunamadı."
GATE_UNRESOLVED = "Önce atıf eşleşmesini/uyuşmazlığını çözün."
GATE_UNVERIFIED = "Kaynak kimliği doğrulanmadı; eşleşmeyi inceleyip kabul edin."
GATE_NO_TEXT = "Tam metne veya özete ulaşılamadı."
GATE_CONFIRM = "PDF’nin yayın kimliğini ve sürümünü önizleyip kabul edin."
GATE_NO_CLAIMS = "Model iddia değerlendirmesi sağlamadı."

FIELD_TITLE, FIELD_AUTHOR, FIELD_PUBLISHED = "Başlık", "Yazar", "Yayın tarihi"
FIELD_MODIFIED, FIELD_SITE = "Güncelleme tarihi", "Site"
FIELD_DATE_FALLBACK = "Tarih (güncelleme; yayın tarihi bulunamadı)"
CONFLICT_DATE = "Yayın tarihi kanıtları çelişiyor"
CONFLICT_AUTHOR = "Yazar metadata alanları farklı; görünür yazar satırını kontrol edin"
CONFLICT_CANONICAL = "Canonical adresi ile açılan sayfa farklı; adresi kontrol edin"
CONFLICT_HEADLINE = "Görünen yazı başlığı alınamadı; yalnız sayfa meta bilgileri mevcut"

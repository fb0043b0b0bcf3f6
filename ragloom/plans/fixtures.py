"""The corpus that the queries run on, made of the test tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.corpus import hoisted

ACTIONS = ["tim_kiem", "them_moi", "luu_nhap", "gui_phe_duyet", "duyet", "tu_choi", "uy_quyen", "ban_giao", "chia_se", "in", "them_ghi_chu", "dinh_kem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. One of fewer files than cores, and less data than these read at once, is dealt to all cores: its row groups are too few to share out."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    files = found.inputFiles()
    if len(files) >= cores:
        return found
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    sizes = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return found.repartition(cores) if 1 << 20 < sizes < cores * (128 << 20) else found


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One chunk for each document: metadata by rules of the id, vectors where there are any."""
    d = F.col("doc_id")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.pmod(d, F.lit(13)) + 1).cast("int"))
    metadata = F.to_json(
        F.struct(
            F.col("source"),
            F.when(d % 3 == 0, "instruction_text").when(d % 3 == 1, "image_ui_description").alias("content_kind"),
            F.when(d % 5 != 0, d % 7).alias("page"),
            (d % 11).alias("slide"),
            F.when(d % 13 < 12, action).alias("action_kind"),
            F.when(d % 2 == 0, "procedure_steps").otherwise("ui_details").alias("instruction_role"),
            F.concat(F.lit("files/"), F.col("source"), F.lit(".pptx")).alias("relative_path"),
            (d % 17).alias("chunk_index"),
            F.when(d % 4 == 0, F.concat(F.lit("Title "), d % 6)).alias("slide_title"),
        )
    )
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), d).alias("id"), d.alias("row_seq"), F.col("text").alias("document"), metadata.alias("metadata"))
    chunks = hoisted(chunks)
    if vectors:
        own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_seq"), "embedding")
        chunks = chunks.join(own, "row_seq", "left")
    return chunks


CORPUS_SQL = f"""corpus AS (
  SELECT 'doc_' || doc_id AS id, doc_id AS row_seq, text AS document, source,
    CASE doc_id % 3 WHEN 0 THEN 'instruction_text' WHEN 1 THEN 'image_ui_description' END AS content_kind,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 7 AS VARCHAR) END AS page,
    CAST(doc_id % 11 AS VARCHAR) AS slide,
    CASE WHEN doc_id % 13 < 12 THEN [{", ".join(f"'{a}'" for a in ACTIONS)}][doc_id % 13 + 1] END AS action_kind,
    CASE WHEN doc_id % 2 = 0 THEN 'procedure_steps' ELSE 'ui_details' END AS instruction_role,
    'files/' || source || '.pptx' AS relative_path,
    CAST(doc_id % 17 AS VARCHAR) AS chunk_index,
    CASE WHEN doc_id % 4 = 0 THEN 'Title ' || (doc_id % 6) END AS slide_title
  FROM documents)"""

#: Sentences in Vietnamese, with and without accents, and others: the corpus has none.
MESSAGES = [
    "Cách tạo tờ trình nghiệp vụ?", "Nút phê duyệt nằm ở đâu?", "Chương trình đào tạo gồm những gì", "Trường nào bắt buộc nhập trên màn hình?",
    "các bước duyệt tờ trình", "In tờ trình nghiệp vụ", "tờ trình nghiệp vụ", "Thêm mới hồ sơ", "them ghi chu vao to trinh", "Đính kèm hình ảnh vào văn bản",
    "Gửi phê duyệt tờ trình", "Xem chi tiết hồ sơ", "Tìm kiếm theo ngày", "Ủy quyền cho người khác", "BÀN GIAO công việc", "Từ chối yêu cầu", "Chia sẻ tài liệu",
    "lưu nháp", "tạo mới", "20110123 là của ai?", "MSSV 20110123", "Email của Nguyễn Văn An là gì", "email cua Tran Thi Binh?", "của ai", "là của ai", "ai vậy",
    "Xin chào", "hello", "Chào", "alo", "Lớp nào có sinh viên này", "hướng dẫn sử dụng menu", "layout cua giao dien", "Bước 1: mở màn hình. Bước 2: bấm nút. BƯỚC 3: lưu",
    "B1: mo\nB2: luu\nB1: xoa\nB2: dong", "Chuẩn bị. Buoc 1: a Buoc 2: b Buoc 1: c", "bước 12 : xong", "ab12345678cd 123456 9876543", "", "   ", "dinh kem file va dinh kem anh",
    "phe duyet", "xem o nao", "print in color", "inbox", "đường Đinh Tiên Hoàng", "tạo mới rồi Từ chối", "chia sẻ, tu choi , tao moi",
    "Nút và bảng tìm kiếm trạng thái: số liệu " + "1234567." * 40, "ÀÉÎÕÜ ñ ç ß Ø",
]

def messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "query_id int, text string")


#: Records of customers in four ways of writing them, and rows of parts, which have no person; odd ones among them.
_CUSTOMER = """CASE c_custkey % 4
    WHEN 0 THEN concat('Mã số ID: ', 20000000 + c_custkey, ', Họ tên: ', c_name, ', Email: c', c_custkey, '@example.com, Lớp: ', c_mktsegment)
    WHEN 1 THEN concat('MSSV: ', 20000000 + c_custkey, ', Name: "', c_name, ', Lê Châu", Mail: ', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat(c_custkey, '@example.org') END, ', Class: ', c_mktsegment)
    WHEN 2 THEN concat('Ten sinh vien: ', c_name, ', Lop: ', c_mktsegment, ', Mã ID: ', 20000000 + c_custkey, ', Ghi chú: a:b, :x, y:')
    ELSE concat('Địa chỉ thư điện tử: x', c_custkey, '@example.net, Họ: Trần, Tên: ', c_name, ', Student ID: ', 20000000 + c_custkey, ', Ho: another') END"""
_PART = "concat('p_name: ', p_name, ', p_brand: ', p_brand, CASE WHEN p_partkey % 2 = 0 THEN ', x: \"1, 2, y: 3, z: 4' ELSE '' END)"
RECORDS_SQL = f"records(record_id, text) AS (SELECT c_custkey * 2, {_CUSTOMER} FROM customer UNION ALL SELECT p_partkey * 2 + 1, {_PART} FROM part)"
#: Questions of conversations: by id, by e-mail and name, by name alone, and what was said.
_SAID = """CASE WHEN k % 5 = 0 THEN concat(20000000 + k % 400, ' là của ai?')
    WHEN k % 5 = 1 THEN concat('Email của ', CASE WHEN k % 2 = 0 THEN 'customer#00000' ELSE 'Customer#000000' END, lpad(CAST(k % 300 AS STRING), 3, '0'), ' là gì')
    WHEN k % 5 = 2 THEN concat('email cua Trần Customer#', lpad(CAST(k % 900 AS STRING), 9, '0'), '?')
    WHEN k % 5 = 3 THEN concat('lê châu ', k, ' của ai, của #', lpad(CAST(k % 77 AS STRING), 9, '0'))
    ELSE text END"""
QUESTIONS_SQL = f"questions AS (SELECT k AS query_id, {_SAID.replace('STRING', 'VARCHAR')} AS text FROM (SELECT conv_id * 100 + turn AS k, text FROM conversations))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("record_id"), F.expr(_CUSTOMER).alias("text"))
    return customers.unionAll(table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("record_id"), F.expr(_PART).alias("text")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    return said.select(F.col("k").alias("query_id"), F.expr(_SAID).alias("text"))


def values_sql(name: str, rows: list[str], key: str) -> str:
    quoted = ", ".join("({}, '{}')".format(i, m.replace("'", "''")) for i, m in enumerate(rows))
    return f"{name}({key}, text) AS (VALUES {quoted})"


MESSAGES_SQL = values_sql("messages", MESSAGES, "query_id")


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(strip_accents(lower({x})), 'đ', 'd'), '\\s+', ' ', 'g'))"

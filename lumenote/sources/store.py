"""The application's tables as partitioned Parquet with real types, and upserts into them.

A table is a folder, dealt to partitions by a hash of its key, so a key's row never moves between partitions. An upsert
reads and rewrites only the partitions that its rows fall in (dynamic partition overwrite): new files are staged and put
in place when the job commits, and readers of other partitions notice nothing. Rows of a batch with the same key are
merged like rows of successive batches. A null key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The names of the tables, their columns and keys; texts of times are timestamps, of days dates.
TABLES = {
    "log_etl": ("id long, data_hora timestamp, tipo_acao string, arquivo_gerado string, status string", ["id"]),
    "chat_history": ("id long, data_hora timestamp, pergunta string, resposta string, conversa_id string, dono string", ["id"]),
    "metricas_latencia": (
        "id long, data_hora timestamp, rota string, ttft_ms long, ttfa_ms long, total_ms long, stt_ms long, decode_tok_s double, n_tokens long, vad_ms long, extrator_ms long, busca_ms long, "
        "lock_wait_ms double, prefill_ms double, decode_tok_s_gpu double, reload_frio long, vram_peak_mb double, tts_synth_ms_total double, tts_synth_ms_max double, tts_frases long, "
        "melhor_dist double, relevante long, sentinela long, escalou_web long",
        ["id"],
    ),
    "base_snapshot": ("id long, data_hora timestamp, total long, por_origem string, novos long", ["id"]),
    "academico_pdfs": ("url string, data_hora timestamp", ["url"]),
    "router_log": ("id long, data_hora timestamp, origem string, texto string, bruto string, tool string, parse_ok long", ["id"]),
    "agendamentos": ("id long, tipo string, mensagem string, proximo_disparo timestamp, recorrencia string, payload string, status string, criado_em timestamp, conversa_id string, dono string", ["id"]),
    "auditoria": ("id long, data_hora timestamp, acao string, detalhe string, dono string", ["id"]),
    "srs_cards": ("id long, frente string, verso string, proxima_revisao timestamp, estagio long, criado_em timestamp, dono string", ["id"]),
    "gatilhos": ("id long, evento string, filtro string, acao string, descricao string, criado_em timestamp, dono string", ["id"]),
    "contradicoes": ("id long, fonte_a string, fonte_b string, resumo string, data timestamp, resolvido long", ["fonte_a", "fonte_b"]),
    "mensagens": ("id long, remetente string, destinatario string, texto string, tipo string, criada_em timestamp, lida_em timestamp", ["id"]),
    "lacunas": ("chave string, dono string, termos string, n long, visto_em timestamp, pesquisado_em timestamp", ["chave", "dono"]),
    "temas_quentes": ("chave string, dono string, termos string, n long, visto_em timestamp, pesquisado_em timestamp", ["chave", "dono"]),
    "mestre_nao_reconhecido": ("chave string, dono string, comando string, n long, visto_em timestamp", ["chave", "dono"]),
    "mestre_frequencia": ("assinatura string, dono string, exemplo string, n long, sugerido long, visto_em timestamp", ["assinatura", "dono"]),
    "mestre_atalhos": ("nome string, dono string, comando string, criado_em timestamp", ["nome", "dono"]),
    "rotinas": ("nome string, dono string, comando string, criado_em timestamp", ["nome", "dono"]),
    "habitos": ("id long, dono string, nome string, data date, criado_em timestamp", ["nome", "data", "dono"]),
    "perfil_conversa": ("chave string, dono string, valor string, atualizado_em timestamp", ["chave", "dono"]),
    "consumo_diario": ("dia date, gpu_j double, cpu_j double, segundos double, amostras long, parede_min_j double, parede_max_j double", ["dia"]),
    "aparelhos": ("id string, apelido string, impressao string, sal string, criado_em timestamp, ultimo_uso timestamp, ultimo_ip string, revogado_em timestamp, expira_em timestamp, usuario string", ["id"]),
    "aparelhos_pareamento": ("codigo string, emitido_em timestamp, usado_em timestamp, apelido string, usuario string, validade_minutos long", ["codigo"]),
}


def conformed(rows: DataFrame, table: str) -> DataFrame:
    """The rows with the table's columns and types: missing columns are null (as in stores of an older version), others go."""
    schema = StructType.fromDDL(TABLES[table][0])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table's rows; none before the first upsert."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], TABLES[table][0] + ", part int")
    return spark.read.schema(TABLES[table][0] + ", part int").parquet(f"{folder}/{table}")


def upsert(rows: DataFrame, folder: str, table: str, how: str = "replace", order: str | None = None, sums: tuple[str, ...] = (), parts: int = 64) -> None:
    """Write rows into a table.

    how: replace (the newest row of a key wins), ignore (the oldest stays), add (the columns `sums` add up, null as 0, the
    others are the newest row's). order: a column that tells which row of a key is newer, whatever order they come in;
    without it the later batch's. parts: of the table; the
    same in every call.
    """
    spark, (ddl, keys) = rows.sparkSession, TABLES[table]
    columns = [f.name for f in StructType.fromDDL(ddl)]
    by_key = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    fresh = conformed(rows, table).select(*columns, by_key, F.lit(1).alias("_new"))
    touched = [r.part for r in fresh.select("part").distinct().collect()]  # at most `parts`
    if not touched:
        return
    old = read_table(spark, folder, table).filter(F.col("part").isin(touched)).select(*columns, "part", F.lit(0).alias("_new"))
    place = F.struct(*([order] if order else []), "_new")
    rest = [c for c in columns if c not in keys and c not in sums]
    # several columns, null or not, of one row
    picked = (F.min_by if how == "ignore" else F.max_by)(F.struct(F.lit(0).alias("_"), *rest), place).alias("_row")
    added = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums]
    merged = old.unionByName(fresh).groupBy("part", *keys).agg(picked, *added)
    values = {c: F.col(c) if c in keys or c in sums else F.col("_row")[c] for c in columns}
    out = merged.select(*(v.alias(c) for c, v in values.items()), "part").hint("rebalance", "part")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{table}")

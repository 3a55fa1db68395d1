"""Five labelled synthetic tables made by rule, with their target schemas and expected targets."""

from schemaweave.model import TargetField as Field
from schemaweave.model import TargetSchema


def _n(k):
    return f"{k:02d}"


def _date(k):
    return f"{k:02d}/{k % 12 + 1:02d}/2026"


def clientes():
    rows = []
    for k in range(1, 21):
        cpf = "SEM CPF" if k == 20 else "529.982.247-25" if k % 2 else "11144477735"
        born = "data desconhecida" if k == 20 else _date(k) if k <= 12 else f"2026-01-{k}"
        rows.append([f"Cliente Sintetico {_n(k)}", cpf, f"(11) 99999-{k:04d}", born, f"00{100 + k}", f"nota {_n(k)}"])
    schema = TargetSchema("clientes", "1", [
        Field("customer.name", "Nome", ["Nome Completo"], required=True),
        Field("customer.document", "CPF", ["Documento"], semantic_types=["br:cpf"], required=True),
        Field("customer.phone", "Telefone", ["Contato"], semantic_types=["br:phone"]),
        Field("customer.birthDate", "Data de Nascimento", ["Data Nasc"], "DATE", ["core:date"]),
        Field("customer.code", "Codigo Cliente", ["Codigo"], required=True),
        Field("customer.email", "Email", [], semantic_types=["core:email"]),
    ], "customer", "pt-BR")
    labels = [("customer.name", None, False), ("customer.document", "br:cpf", False), ("customer.phone", "br:phone", False), ("customer.birthDate", "core:date", True), ("customer.code", None, False), (None, None, True)]
    return ["Nome Completo", "Documento", "Contato", "dtNasc", "Codigo", "Observacao"], rows, schema, labels


def fornecedores():
    rows = []
    for k in range(1, 21):
        last = k == 20
        rows.append([f"Fornecedor Sintetico {_n(k)}", "INVALIDO" if last else f"12.ABC.345/{k:04d}-DE", f"F{k:03d}", "sem-email" if last else f"compras{_n(k)}@example.test", f"nota {_n(k)}"])
    schema = TargetSchema("fornecedores", "1", [
        Field("supplier.legalName", "Razao Social", ["Razao"], required=True),
        Field("supplier.document", "Documento Empresarial", [], semantic_types=["br:cnpj"], required=True),
        Field("supplier.code", "Codigo Fornecedor", ["Cod"], required=True),
        Field("supplier.email", "Email Comercial", ["Contato"], semantic_types=["core:email"]),
        Field("supplier.phone", "Telefone", [], semantic_types=["br:phone"]),
    ], "supplier", "pt-BR")
    labels = [("supplier.legalName", None, False), ("supplier.document", "br:cnpj", False), ("supplier.code", None, False), ("supplier.email", "core:email", False), (None, None, True)]
    return ["Razao", "Registro X", "Cod", "Contato", "Notas Internas"], rows, schema, labels


def pedidos():
    rows = [[f"PED-{k:04d}", f"2026-02-{_n(k)}", str(k), f"{10.5 * k:.2f}", f"C{k:03d}", f"123456789{_n(k)}"] for k in range(1, 21)]
    schema = TargetSchema("pedidos", "1", [
        Field("order.code", "Codigo Pedido", ["Pedido"], required=True),
        Field("order.date", "Data Emissao", ["Emissao"], "DATE", ["core:date"]),
        Field("order.quantity", "Quantidade", ["Qtd"], "INTEGER"),
        Field("order.amount", "Valor Total", ["Total"], "DECIMAL"),
        Field("order.customerCode", "Codigo Comprador", ["Comprador"]),
    ], "order", "pt-BR")
    labels = [("order.code", None, False), ("order.date", "core:date", False), ("order.quantity", None, False), ("order.amount", None, False), ("order.customerCode", None, False), (None, None, True)]
    return ["Pedido", "Emissao", "Qtd", "Total", "Comprador", "Contato"], rows, schema, labels


def estoque():
    rows = [[f"SKU-{k:03d}", f"Item Sintetico {_n(k)}", "UN", str(k), f"{5 + 0.25 * k:.2f}", f"COD{k:08d}"] for k in range(1, 21)]
    schema = TargetSchema("estoque", "1", [
        Field("stock.sku", "SKU", ["Ref"], required=True),
        Field("stock.description", "Descricao", ["Item"]),
        Field("stock.unit", "Unidade", ["UM"]),
        Field("stock.quantity", "Quantidade", ["Saldo"], "INTEGER"),
        Field("stock.price", "Preco Unitario", ["Preco Unit"], "DECIMAL"),
    ], "stock", "pt-BR")
    labels = [("stock.sku", None, False), ("stock.description", None, False), ("stock.unit", None, False), ("stock.quantity", None, False), ("stock.price", None, False), (None, None, True)]
    return ["Ref", "Item", "UM", "Saldo", "Preco Unit", "Contato"], rows, schema, labels


def financeiro():
    rows = []
    for k in range(1, 21):
        due = "data desconhecida" if k == 20 else _date(k % 12 + 1)
        rows.append([f"FAT-{k:04d}", due, f"{99.5 + k:.2f}", "PAGO" if k % 3 == 0 else "ABERTO", f"(11) 99999-{k:04d}" if k % 2 else "texto livre"])
    schema = TargetSchema("financeiro", "1", [
        Field("finance.document", "Numero Documento", ["Documento"], required=True),
        Field("finance.dueDate", "Data Vencimento", ["Vencto"], "DATE", ["core:date"]),
        Field("finance.amount", "Valor", ["Montante"], "DECIMAL"),
        Field("finance.status", "Status", ["Situacao"]),
    ], "finance", "pt-BR")
    labels = [("finance.document", None, False), ("finance.dueDate", "core:date", True), ("finance.amount", None, False), ("finance.status", None, False), (None, "br:phone", True)]
    return ["Documento", "Vencto", "Montante", "Situacao", "Contato"], rows, schema, labels


ALL = (clientes, fornecedores, pedidos, estoque, financeiro)


def as_csv(headers, rows, delimiter=","):
    return "".join(delimiter.join(r) + "\n" for r in [headers, *rows]).encode()

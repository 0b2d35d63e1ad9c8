"""Fixed values of the invoice domain: field names, word lists, patterns."""

# Record fields in output order, with their dataset classes.
FIELDS = (
    "invoice_type",
    "invoice_code",
    "invoice_no",
    "invoice_date",
    "buyer_name",
    "buyer_tax_id",
    "seller_name",
    "seller_tax_id",
    "total",
    "amount",
    "tax",
    "checksum",
    "drawer",
)
CLASSES = (
    "invoice_type",
    "invoice_code",
    "invoice_no",
    "invoice_date",
    "checksum",
    "buyer_name",
    "buyer_tax_id",
    "seller_name",
    "seller_tax_id",
    "amount",
    "tax",
    "total",
    "drawer",
)
REQUIRED = ("invoice_no", "invoice_type", "invoice_date", "buyer_name", "seller_name", "seller_tax_id", "total")

# How a text names each field.
LABELS = {
    "发票类型": "invoice_type",
    "发票代码": "invoice_code",
    "发票号码": "invoice_no",
    "开票日期": "invoice_date",
    "校验码": "checksum",
    "购买方名称": "buyer_name",
    "购买方税号": "buyer_tax_id",
    "销售方名称": "seller_name",
    "销售方税号": "seller_tax_id",
    "金额": "amount",
    "税额": "tax",
    "价税合计": "total",
    "开票人": "drawer",
}
# Words of detectors for fields, besides those.
ALIASES = {
    "invoice_number": "invoice_no",
    "date": "invoice_date",
    "check_code": "checksum",
    "tax_amount": "tax",
    "total_amount": "total",
    "issuer": "drawer",
    **LABELS,
}

# Primary patterns by field, tried in order on normalised text.
MONEY = r"([0-9]{1,12}(?:,[0-9]{3})*(?:\.[0-9]{1,2})?)"
PRIMARY = {
    "invoice_type": (r"(增值税电子普通发票|增值税普通发票|增值税专用发票|电子发票|普通发票)",),
    "invoice_code": (r"发票代码[:：]?\s*([0-9]{8,12})(?!\d)",),
    "invoice_no": (r"发票号码[:：]?\s*([0-9]{8,20})(?!\d)", r"号码[:：]?\s*([0-9]{8,20})(?!\d)"),
    "invoice_date": (r"开票日期[:：]?\s*([0-9]{4}[年\-/\.][0-9]{1,2}[月\-/\.][0-9]{1,2}日?)", r"开票日期[:：]?\s*([0-9]{4}[01][0-9][0-3][0-9])"),
    "buyer_name": (r"购买方名称[:：]?\s*([^\n]+)", r"购买方[:：]?\s*([^\n]+)"),
    "buyer_tax_id": (),
    "seller_name": (r"销售方名称[:：]?\s*([^\n]+)", r"销售方[:：]?\s*([^\n]+)"),
    "seller_tax_id": (r"销售方.{0,80}?(?:纳税人识别号|税号)[:：]?\s*([A-Z0-9]{12,20})", r"代开企业税号[:：]?\s*([A-Z0-9]{12,20})"),
    "total": (r"价税合计[^\n]{0,80}?[¥￥]\s*" + MONEY, r"小写\)?[:：]?\s*[¥￥]\s*" + MONEY),
    "amount": (r"金额[^\n]{0,20}?[¥￥]\s*" + MONEY,),
    "tax": (r"税额[^\n]{0,20}?[¥￥]\s*" + MONEY,),
    "checksum": (r"校验码[:：]?\s*([0-9 ]{8,})",),
    "drawer": (r"开票人[:：]?\s*([一-龥]{2,4})",),
}

# Word lists.
ORG_SUFFIX = "公司|税务局|合作社|商店|中心|厂|部|研究所|研究院|科学院|学院|大学|学校|医院|委员会|管理局|银行|酒店|宾馆|饭店|集团|事务所|经营部|商行"
NAME_NOISE = ("销售方", "购买方", "收款人", "复核", "开票人", "备注", "名称", "纳税", "识别", "开户", "账号", "地址", "电话", "专用章", "专用", "爱票", "票专", "发票", "凭证", "合计", "税额", "金额", "单位", "数量", "单价")
ACCOUNT_NAMES = ("管理员", "开票员", "财务", "会计", "系统")
COMPOUND_SURNAMES = ("欧阳", "太史", "端木", "上官", "司马", "东方", "独孤", "南宫", "万俟", "闻人", "夏侯", "诸葛", "尉迟", "公羊", "赫连", "澹台", "皇甫", "宗政", "濮阳", "公冶", "太叔", "申屠", "公孙", "慕容", "仲孙", "钟离", "长孙", "宇文", "司徒", "鲜于", "司空", "闾丘", "子车", "亓官", "司寇", "巫马", "公西", "颛孙", "壤驷", "公良", "漆雕", "乐正", "宰父", "谷梁", "拓跋", "夹谷", "轩辕", "令狐", "段干", "百里", "呼延", "东郭", "南门", "羊舌", "微生")
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜"
    "戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费"
    "廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和"
    "穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋庞熊纪舒屈项祝董梁杜阮"
    "蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田胡凌霍虞万支"
    "柯昝管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程邢裴陆荣"
    "翁荀羊於惠甄曲家封芮羿储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓"
    "蓬全郗班仰秋仲伊宫宁仇栾暴甘斜厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟"
    "薄印宿白怀蒲台从鄂索咸籍赖卓蔺屠蒙池乔阴胥能苍双闻莘党翟谭贡劳逄"
    "姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀浦尚农温庄晏柴瞿阎充慕连"
    "茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿满弘匡国文寇广禄阙东殴殳"
    "沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关"
    "蒯相查后荆红游竺权逯盖益桓公"
)
STAMP_NOISE = ("发票专用章", "专用章", "爱票", "监制章", "收款人", "复核", "开票人", "发票联", "税总函", "印制有限公司", "印刷有限公司", "安全印刷", "国家税务总局", "监制")
BARE_COMPANIES = ("有限公司", "业有限公司", "责任公司", "股份公司")
BLOCK_WORDS = ("发票代码", "发票号码", "开票日期", "校验码", "购买方", "销售方", "税率")
TAX_LABELS = ("纳税人识别号", "税号", "统一社会信用代码")
TAX_NOISE = ("规格型号", "开户行", "账号", "HHE")
BUYER_STOPS = ("销售方", "销售信息", "货物或应税劳务", "项目名称", "价税合计", "合计")
TOTAL_MARKS = ("价税合计", "小写")
NO_MONEY = ("发票代码", "发票号码", "纳税人识别号", "账号")
BANK_NOISE = ("银行", "支行", "分行", "印制")
AGENT_STOPS = ("纳税人识别号", "地址", "电话", "开户行", "账号", "开票人", "复核", "收款人", "完税凭证")
AGENT_SKIPS = ("销售方", "购买方", "备注", "备", "注", "代开机关")
PREFERRED_SELLERS = ("税务局", "代开", "有限公司")
SELLER_NOISE = ("开票单位", "开票人", "收款人", "复核", "开户行", "银行", "账号", "发票专用章", "专用章", "印制有限公司", "税总函")
REGION_NAME_NOISE = ("开票单位", "开票人", "收款人", "复核", "开户行", "银行", "账号", "发票专用章", "专用章", "印制有限公司", "印刷有限公司", "安全印刷", "税总函", "国家税务总局", "监制")
# Fixed value: the range of characters in names.
CJK = "一-龥"
# Fixed value: sums in running text.
MONEY_FIND = r"(?<![0-9.])[¥￥]?\s*([0-9]{1,12}(?:,[0-9]{3})*(?:\.[0-9]{2}))(?![0-9])"
# Fixed value: tax numbers in running text.
ID_FIND = r"(?<![0-9A-Z])(?=[0-9A-Z]*[A-Z])(?=[0-9A-Z]*[0-9])[0-9A-Z]{15,20}(?![0-9A-Z])"

# How a result says which way it was made.
MODE_OFF, MODE_PDF, MODE_FORCED = "未启用 YOLO", "PDF 已抽取到可用文本，跳过 YOLO", "手动启用 {0} 辅助定位"
MODE_USED, MODE_FELL_BACK = "{0}，使用 {1}", "{0}；{1} 不可用，已回退普通 OCR：{2}"
